"""Catalogue: model searches, scoring, explanations, persistence, report, CSV.

No SQL equals a model fit, so queries about fitted models return the operator's own
columns and have no SQL; tests hold them against plain loops over the fitted models.
What SQL can state has its own query (feature slots, the report's cohort rows).

Every family is tuned once per application and data folder by its whole search
(10 candidates x 3 folds), which all these queries share.
"""
from __future__ import annotations

import datetime
import json
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import expr as X
from ..ml import explain as E
from ..ml import scoring as SC
from ..ml.persist import load_models, save_models
from ..ml.preprocess import feature_columns, selected_features
from ..ml.search import FAMILIES, fit_selector, train_family
from ..operators import metrics as M
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.csv_io import read_table_csv, write_table_csv
from .prepare import prepare, raw_cohort
from .registry import query
from .report import cohort_rows, report_rows, report_text
from .sql import BASE, COHORT_DOUBLE, COHORT_GRADES, PREP, RAW_ORDER
from .training import (CLF_FAMILIES, REG_FAMILIES, choose_best, excluded_columns, fit_subject_models, fold_column, model_frame,
                       test_metrics, with_observed)

_LOCK = threading.RLock()
_LOCKS: dict = {}
_CACHE: dict = {}


def _once(spark, sf_dir, *rest, make):
    """``make()`` once per application, data folder and name; different names may be made at the same time."""
    key = (spark.sparkContext.applicationId, sf_dir, *rest)
    with _LOCK:
        own = _LOCKS.setdefault(key, threading.RLock())
    with own:
        if key not in _CACHE:
            _CACHE[key] = make()
        return _CACHE[key]


def cohorts(spark, sf_dir):
    """The raw cohort and the model frame over it, as one materialised table each."""
    def make():
        raw = raw_cohort(spark, sf_dir)
        return raw, cut_lineage(model_frame(prepare(raw)))
    return _once(spark, sf_dir, "frame", make=make)


def frame(spark, sf_dir):
    return cohorts(spark, sf_dir)[1]


def _label(family):
    return K.TARGET_REG if FAMILIES[family][0] == "regression" else K.TARGET_CLF


def searched(spark, sf_dir, family):
    """The tuned model of a family: its whole search, on the training students."""
    def make():
        fr = frame(spark, sf_dir)
        excl = [c for c in excluded_columns(fr) if c != _label(family)]
        return train_family(fr.where(~F.col("is_test")), _label(family), family, excl, fold_col=fold_column(fr, FAMILIES[family][0]))
    return _once(spark, sf_dir, "search", family, make=make)


def subjects(spark, sf_dir):
    """One model per subject on the grades that were observed, with the tuned parameters of the boosted trees."""
    def make():
        raw, fr = cohorts(spark, sf_dir)
        seen = cut_lineage(with_observed(fr, raw, COHORT_GRADES))
        return fit_subject_models(seen, COHORT_GRADES, excluded_columns(seen), searched(spark, sf_dir, "gbt_reg").best_params)
    return _once(spark, sf_dir, "subjects", make=make)


def metrics_rows(spark, sf_dir, families=None):
    """Scores of the tuned models on the test students.  The families of many short jobs are searched one after
    the other before the perceptrons: beside these, every short job would wait for a core that a task of theirs
    holds for as long as several epochs take."""
    fr = frame(spark, sf_dir)
    families = families or REG_FAMILIES + CLF_FAMILIES

    def one(family):                                   # once, whatever families are asked for beside it
        return _once(spark, sf_dir, "scores", family,
                     make=lambda: test_metrics(searched(spark, sf_dir, family), fr.where("is_test"), _label(family)))

    def make():
        rows = {f: one(f) for f in families if not f.startswith("mlp")}
        long = [f for f in families if f not in rows]
        with ThreadPoolExecutor(max_workers=max(1, len(long))) as pool:
            rows.update(zip(long, pool.map(one, long)))
        return [rows[f] for f in families]
    return _once(spark, sf_dir, "metrics", *families, make=make)


def best_model(spark, sf_dir, task):
    """The tuned model that the metric table chooses for a task."""
    fams = REG_FAMILIES if task == "regression" else CLF_FAMILIES
    return searched(spark, sf_dir, choose_best(metrics_rows(spark, sf_dir, fams))[task])


def _text(params):
    return json.dumps(params, sort_keys=True, default=str)


def _register_search(name, family, doc):
    """``family, candidate, cv_score, chosen``: one row per candidate."""
    def fn(spark, sf_dir):
        res = searched(spark, sf_dir, family)
        rows = [(family, _text(c), float(s), c == res.best_params) for c, s in res.cv_scores]
        return spark.createDataFrame(rows, "family string, candidate string, cv_score double, chosen boolean")
    fn.__doc__ = doc
    query(name)(fn)


_register_search("search_gbt_regression", "gbt_reg",
                 "M6+M12 (M4, M5): boosted trees, 10 of 27 grid points x 3 hash folds, best mean R².")
_register_search("search_rf_classification", "rf_clf",
                 "M7+M12 (A18): balanced random forest, 10 of 12 grid points x 3 folds, best accuracy.")
_register_search("search_mlp_regression", "mlp_reg",
                 "M9+M12: MLP regression (relu/tanh), 10 of 12 grid points x 3 folds in one gradient loop.")
_register_search("search_mlp_classification", "mlp_clf",
                 "M8+M12: MLP classification, 10 of 12 grid points x 3 folds in one gradient loop.")
_register_search("search_svm_regression", "svr",
                 "M10+M12: epsilon-SVR on rbf/poly feature maps, 10 of 18 grid points x 3 folds.")
_register_search("search_svm_classification", "svc",
                 "M11+M12: SVC (linear/rbf), all 6 grid points x 3 folds, Platt probabilities.")


@query("model_metrics")
def model_metrics(spark, sf_dir):
    """M24 (A15, A16): the metric table of the six tuned families on the test students."""
    return M.metric_table(spark, metrics_rows(spark, sf_dir))


@query("best_models")
def best_models(spark, sf_dir):
    """The chosen family of each task and its score."""
    rows = metrics_rows(spark, sf_dir)
    out = [(task, f, next(float(m[key]) for m in rows if m["family"] == f))
           for task, key in (("regression", "r2"), ("classification", "accuracy")) for f in [choose_best(rows)[task]]]
    return spark.createDataFrame(out, "task string, family string, score double")


_SLOT_NUM = ["interet_maths", "heures_jeux_video", "heures_reseaux_sociaux", "heures_streaming", "heures_etude_soir",
             "heures_sommeil", "heure_coucher_num", "heure_lever_num", "temps_ecrans_total", "score_equilibre",
             "ratio_etude_ecrans", "stress_total", "indice_motivation"]


_SLOT_TXT = ["classe", "activite_sportive", "stress_personnel"]
_TRAIN = ("CAST(CAST(('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8)) "
          f"AS BIGINT) AS DOUBLE) >= {0.2 * 2 ** 32!r}")


@query("feature_slots", sql=f"""{PREP}, tr AS (SELECT * FROM feat WHERE {_TRAIN}),
slots AS ({' UNION ALL '.join(f"SELECT {i} AS k, 0 AS u, '' AS v, '{c}' AS feature" for i, c in enumerate(_SLOT_NUM))}
  UNION ALL {' UNION ALL '.join(f"SELECT DISTINCT {len(_SLOT_NUM) + i}, 0, CAST({c} AS VARCHAR), '{c}_' || CAST({c} AS VARCHAR) FROM tr WHERE {c} IS NOT NULL UNION ALL SELECT {len(_SLOT_NUM) + i}, 1, '', '{c}___unknown'" for i, c in enumerate(_SLOT_TXT))})
SELECT CAST(row_number() OVER (ORDER BY k, u, v) - 1 AS INTEGER) AS position, feature FROM slots""")
def feature_slots(spark, sf_dir):
    """M4 (M3): the slots of the assembled matrix in order."""
    return _selection(spark, sf_dir).select("position", "feature")


@query("selected_features")
def selected_features_q(spark, sf_dir):
    """M20 (M5): every slot of the matrix, and whether the selector keeps it."""
    return _selection(spark, sf_dir)


def _selection(spark, sf_dir):
    fr = frame(spark, sf_dir)
    model = _once(spark, sf_dir, "selector", make=lambda: fit_selector(
        fr.where(~F.col("is_test")), K.TARGET_REG, [c for c in excluded_columns(fr) if c != K.TARGET_REG]))
    return selected_features(model, fr.limit(1))


@query("predict_all")
def predict_all_q(spark, sf_dir):
    """M17 (M13, M15): every student's identity and actual mean, the predictions of the best regressor and
    of every subject model, and the gap."""
    subj = {s: r.model for s, r in subjects(spark, sf_dir).items()}
    return SC.predict_all(frame(spark, sf_dir), best_model(spark, sf_dir, "regression").model, subj)


@query("pass_probability")
def pass_probability_q(spark, sf_dir):
    """Pass probability (x100) by the best classifier for every test student."""
    test = frame(spark, sf_dir).where("is_test")
    return SC.pass_probability(best_model(spark, sf_dir, "classification").model, test).select("id", K.TARGET_CLF, "proba_reussite")


@query("what_if_models")
def what_if_models(spark, sf_dir):
    """M18 (P5, X13, X20): per student, 'sleep 8 h' and 'no games' scenarios scored by the best models."""
    fr = frame(spark, sf_dir)
    none = F.lit(None).cast("double")
    scen = fr.select("id", F.explode(F.array(
        F.struct(F.lit("sleep_8h").alias("scenario"), F.lit(8.0).alias("heures_sommeil"),
                 none.alias("heures_jeux_video")),
        F.struct(F.lit("no_games").alias("scenario"), none.alias("heures_sommeil"),
                 F.lit(0.0).alias("heures_jeux_video")))).alias("s")).select("id", "s.*")
    reg, clf = best_model(spark, sf_dir, "regression"), best_model(spark, sf_dir, "classification")
    feats = list(reg.feature_cols[0]) + list(reg.feature_cols[1])
    out = SC.what_if_predict(fr, scen, reg.model, clf.model, feature_cols=feats)
    return out.select("id", "scenario", "note_predite", "proba_reussite", "band", "at_risk")


_DEF_NUM = ["interet_maths", "heures_jeux_video", "heures_reseaux_sociaux", "heures_streaming",
            "heures_etude_soir", "heures_sommeil", "heure_coucher_num", "heure_lever_num", "temps_ecrans_total",
            "score_equilibre", "ratio_etude_ecrans", "stress_total", "indice_motivation"]
_DEF_TXT = ["classe", "activite_sportive", "stress_personnel"]
_DEFAULTS_SQL = f"{PREP} " + " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, 'number' AS kind, coalesce(CAST(median({c}) AS DOUBLE), 0.0) AS default_value, "
     f"CAST(NULL AS VARCHAR) AS option FROM feat" for c in _DEF_NUM]
    + [f"SELECT DISTINCT '{c}' AS feature, 'option' AS kind, CAST(NULL AS DOUBLE) AS default_value, "
       f"CAST({c} AS VARCHAR) AS option FROM feat WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> ''"
       for c in _DEF_TXT])


@query("numeric_defaults", sql=_DEFAULTS_SQL, doubles=["default_value"])
def numeric_defaults_q(spark, sf_dir):
    """Scenario defaults of every model input: exact median per number, options per text."""
    fr = frame(spark, sf_dir)
    num, cat = feature_columns(fr, excluded_columns(fr))
    return SC.numeric_defaults(fr, num + cat)


def _shap(spark, sf_dir, how, **kw):
    """``how`` of the best regressor, the test students, the training students and the model's inputs."""
    res = best_model(spark, sf_dir, "regression")
    fr = frame(spark, sf_dir)
    feats = list(res.feature_cols[0]) + list(res.feature_cols[1])
    return how(res.model, fr.where("is_test"), fr.where("not is_test"), feats, **kw)


@query("shapley_impact")
def shapley_impact(spark, sf_dir):
    """Permutation-sampled Shapley importance over all test students, background rows drawn from all
    training students."""
    return _shap(spark, sf_dir, E.feature_impact)


@query("shapley_failing")
def shapley_failing(spark, sf_dir):
    """The same over the failing test students only (no row when none fail)."""
    return _shap(spark, sf_dir, E.failure_impact)


@query("shapley_kernel")
def shapley_kernel(spark, sf_dir):
    """M21 by kernel-weighted regression over feature coalitions, all test students."""
    return E.global_impact(_shap(spark, sf_dir, E.kernel_shapley, n_coalitions=128))


@query("shapley_sum_rule", sql=f"{PREP} SELECT id, {len(_SLOT_NUM) + len(_SLOT_TXT)} AS n_features, true AS adds_up FROM feat WHERE NOT ({_TRAIN})")
def shapley_sum_rule(spark, sf_dir):
    """M21 per row: a test student's contributions add up to its prediction less the mean prediction of the
    background rows it met, which lies within the range of all training predictions."""
    res = best_model(spark, sf_dir, "regression")
    fr = frame(spark, sf_dir)
    spread = SC.predict(res.model, fr.where("not is_test"), "p").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    sums = _shap(spark, sf_dir, E.shapley_values).groupBy("id").agg(F.sum("phi").alias("s"), F.count("*").cast("int").alias("n_features"))
    own = SC.predict(res.model, fr.where("is_test"), "p").select("id", "p")
    base = F.col("p") - F.col("s")
    return own.join(sums, "id").select("id", "n_features", base.between(spread["lo"] - 1e-6, spread["hi"] + 1e-6).alias("adds_up"))


def _report(spark, sf_dir):
    def make():
        rows = metrics_rows(spark, sf_dir)
        kept = [r["feature"] for r in _selection(spark, sf_dir).where("kept").orderBy("position").collect()]
        impact = [(r["label"], r["mean_abs_impact"]) for r in _shap(spark, sf_dir, E.feature_impact).collect()]
        scored = SC.pass_probability(best_model(spark, sf_dir, "classification").model, frame(spark, sf_dir).where("is_test"))
        scored = SC.predict(best_model(spark, sf_dir, "regression").model, scored, "note_predite")
        return rows, kept, choose_best(rows), impact, scored.where(X.at_risk("proba_reussite", "note_predite")).count()
    rows, kept, best, impact, risk = _once(spark, sf_dir, "report", make=make)
    return report_rows(frame(spark, sf_dir), rows, kept, best, grade_cols=COHORT_GRADES, impact=impact, n_at_risk=risk)


_STATS = [("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")]
_NUMBERS = [("students", "n"), ("mean", "m"), ("passed", "p"), ("failed", "n - p"), ("pass rate", "100.0 * p / n")]


@query("report_cohort", sql=f"""{PREP}, c AS (SELECT count(*) AS n, avg(note_moyenne) AS m, count(*) FILTER (WHERE note_moyenne >= 10) AS p FROM feat)
""" + " UNION ALL ".join(
    [f"SELECT 'cohort' AS section, {i} AS position, '{k}' AS key, CAST({x} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS note FROM c" for i, (k, x) in enumerate(_NUMBERS)]
    + [f"SELECT 'subjects', {4 * j + i}, '{k}', CAST({f}({g}) AS DOUBLE), upper(substr('{g[5:]}', 1, 1)) || substr('{g[5:]}', 2) FROM feat"
       for j, g in enumerate(COHORT_GRADES) for i, (k, f) in enumerate(_STATS)]), doubles=["value"])
def report_cohort(spark, sf_dir):
    """M23 (A12, A13): the report's rows on the cohort and its subjects."""
    return cohort_rows(frame(spark, sf_dir), grade_cols=COHORT_GRADES)


@query("report_rows")
def report_rows_q(spark, sf_dir):
    """All rows of the report: cohort, subjects, kept features, scores of all models, choice, impact, risk."""
    return _report(spark, sf_dir)


@query("report_markdown")
def report_markdown(spark, sf_dir):
    """The report's text, one row per line (undated)."""
    text = report_text(_report(spark, sf_dir), date=datetime.date(2000, 1, 1))
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.rstrip().split("\n")[:-2])], "line int, text string")


_CSV_COLS = ", ".join("CAST(interet_maths AS BIGINT) AS interet_maths" if c == "interet_maths" else c
                      for c in RAW_ORDER)


@query("csv_round_trip", sql=f"{BASE} SELECT {_CSV_COLS} FROM raw", doubles=COHORT_DOUBLE)
def csv_round_trip(spark, sf_dir):
    """S2 + S1 (P1): the raw cohort written as ';' CSV with BOM, read back with separator detection."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv_{uuid.uuid4().hex}"
    write_table_csv(raw_cohort(spark, sf_dir), path)
    return read_table_csv(spark, path)


_TEST_IDS = ("SELECT id FROM feat WHERE CAST(CAST(('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8)) "
             f"AS BIGINT) AS DOUBLE) < {0.2 * 2 ** 32!r}")


@query("model_bundle_round_trip",
       sql=f"{PREP}, t AS ({_TEST_IDS}) SELECT m.model, (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM t) AS n_equal "
           "FROM (VALUES ('nn_reg'), ('svm_reg'), ('reg')) AS m(model)")
def model_bundle_round_trip(spark, sf_dir):
    """Save tuned models of three kinds and reload them; predictions must agree on the test rows."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bundle_{uuid.uuid4().hex}"
    # Both pipelines mix Java stages (scaler, encoders, slicer) with a Python model stage.
    models = {n: searched(spark, sf_dir, f).model for n, f in (("nn_reg", "mlp_reg"), ("svm_reg", "svr"), ("reg", "gbt_reg"))}
    num, cat = searched(spark, sf_dir, "mlp_reg").feature_cols
    save_models(spark, path, models, {"feature_columns": list(num) + list(cat), "target": K.TARGET_REG})
    loaded = load_models(spark, path)
    test = frame(spark, sf_dir).where("is_test")
    out = []
    for name, m in models.items():
        a = SC.predict(m, test, "a")
        b = SC.predict(loaded[0][name], a, "b")
        out.append(b.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"),
                         F.count_if(F.abs(F.col("a") - F.col("b")) < 1e-9).alias("n_equal")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res
