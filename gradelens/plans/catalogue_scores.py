"""Catalogue: linear scoring, metrics, split/folds, encodings, lookups, what-if.

The transparent linear grade (X11) stands in for a fitted model wherever an
exact oracle is wanted: bands, gaps, metrics, what-if and closed-form Shapley
values are then checkable in SQL.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import expr as X
from ..operators import metrics as M
from ..operators import scores as S
from ..operators.cohort import failing, non_empty_options
from ..operators.lookup import aligned_mask, lookup, lookup_rows
from ..operators.profile import null_counts
from ..operators.sampling import fold_of, is_test, with_split, with_stratified_folds
from ..sources.tables import read_table
from .prepare import prepare, prepared_cohort, raw_cohort
from .registry import query
from .sql import (BASE, COHORT_WEIGHTS, PREP, feat_ctes, grades_sql, pred_mean_sql,
                  RAW_ORDER, COHORT_GRADES, sql_str)

PRED_COLS = [f"pred_{s.replace('note_', '')}" for s in K.SUBJECT_BASES]
SCORED = f"""{PREP},
sc0 AS (SELECT *, {grades_sql()} FROM feat),
sc AS (SELECT *, {pred_mean_sql()} AS note_pred FROM sc0)"""


def scored(spark, sf_dir):
    return S.with_subject_grades(prepared_cohort(spark, sf_dir), COHORT_WEIGHTS)


@query("weighted_grade", sql=f"{SCORED} SELECT id, {', '.join(PRED_COLS)}, note_pred FROM sc",
       doubles=PRED_COLS + ["note_pred"])
def weighted_grade(spark, sf_dir):
    """X11: the linear grade signal per subject (own base, clipped to [0, 20]) and its mean."""
    return scored(spark, sf_dir).select("id", *PRED_COLS, "note_pred")


_PT_COLS = ["Note Prédite (Moy)"] + [f"Prédit_{s.replace('note_', '')}" for s in K.SUBJECT_BASES] + ["Écart"]


@query("prediction_table",
       sql=f"""{SCORED} SELECT id, nom, note_moyenne, note_pred AS "Note Prédite (Moy)", """
           + ", ".join(f'{p} AS "Prédit_{p[5:]}"' for p in PRED_COLS)
           + """, note_pred - note_moyenne AS "Écart" FROM sc""",
       doubles=["note_moyenne"] + _PT_COLS)
def prediction_table(spark, sf_dir):
    """M17 (P8, X14): identity, actual, predicted mean, per-subject predictions, gap."""
    df = scored(spark, sf_dir)
    return S.prediction_table(df, "note_pred", dict(zip(K.SUBJECT_BASES, PRED_COLS)))


_BAND = "CASE WHEN note_pred >= 14 THEN 'green' WHEN note_pred >= 10 THEN 'orange' " \
        "WHEN note_pred IS NOT NULL THEN 'red' END"


@query("band_gap",
       sql=f"{SCORED} SELECT id, note_pred, {_BAND} AS band, note_pred - note_moyenne AS gap, "
           f"indice_motivation * heures_etude_soir AS motivation_x_study, "
           f"stress_total * heures_etude_soir AS stress_x_study FROM sc",
       doubles=["note_pred", "gap", "motivation_x_study", "stress_x_study"])
def band_gap(spark, sf_dir):
    """X13 band, X14 gap and X19 interaction terms on the scored cohort."""
    df = scored(spark, sf_dir)
    return df.select("id", "note_pred", X.band("note_pred").alias("band"),
                     X.gap("note_pred", K.TARGET_REG).alias("gap"),
                     X.interaction("indice_motivation", "heures_etude_soir").alias("motivation_x_study"),
                     X.interaction("stress_total", "heures_etude_soir").alias("stress_x_study"))


@query("regression_metrics",
       sql=f"""{SCORED} SELECT count(*) AS n,
  1.0 - sum((note_pred - note_moyenne) * (note_pred - note_moyenne)) / (var_pop(note_moyenne) * count(*)) AS r2,
  avg(abs(note_pred - note_moyenne)) AS mae,
  sqrt(sum((note_pred - note_moyenne) * (note_pred - note_moyenne)) / count(*)) AS rmse
FROM sc WHERE note_pred IS NOT NULL AND note_moyenne IS NOT NULL""",
       doubles=["r2", "mae", "rmse"])
def regression_metrics(spark, sf_dir):
    """R² (1 - SSE/SST), MAE, RMSE of the linear grade against the row mean."""
    return M.regression_metrics(scored(spark, sf_dir), K.TARGET_REG, "note_pred")


_CLS = "CAST(coalesce(note_pred >= 10, false) AS INTEGER)"


@query("classification_metrics",
       sql=f"""{SCORED}, c AS (SELECT reussite AS y, {_CLS} AS p FROM sc),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn, count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn FROM c)
SELECT n, tp, fp, fn, tn, coalesce((tp + tn) * 100.0 / nullif(n, 0), 0.0) AS accuracy,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(tp * 2.0 / nullif(tp * 2 + fp + fn, 0), 0.0) AS f1 FROM t""",
       doubles=["accuracy", "precision", "recall", "f1"])
def classification_metrics(spark, sf_dir):
    """Accuracy %, precision, recall, F1 of the pass label predicted by the linear grade."""
    df = scored(spark, sf_dir).withColumn("pred_pass", X.pass_label("note_pred"))
    return M.classification_metrics(df, K.TARGET_CLF, "pred_pass")


@query("confusion",
       sql=f"""{SCORED}, c AS (SELECT reussite AS y, {_CLS} AS p FROM sc)
SELECT a AS actual, b AS predicted, (SELECT count(*) FROM c WHERE y = a AND p = b) AS count
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS g(a, b)""")
def confusion(spark, sf_dir):
    """2x2 confusion matrix (zero cells included) of the predicted pass label."""
    df = scored(spark, sf_dir).withColumn("pred_pass", X.pass_label("note_pred"))
    return M.confusion_matrix(df, K.TARGET_CLF, "pred_pass")


@query("class_weights",
       sql="""SELECT toxic AS label, count(*) AS count,
  CAST((SELECT count(*) FROM labels WHERE toxic IS NOT NULL) AS DOUBLE)
  / (CAST((SELECT count(DISTINCT toxic) FROM labels) AS DOUBLE) * count(*)) AS weight
FROM labels WHERE toxic IS NOT NULL GROUP BY toxic""",
       doubles=["weight"])
def class_weights(spark, sf_dir):
    """A18: 'balanced' class weights n / (k * n_c) of the toxic label (a real imbalance)."""
    return M.class_balance(read_table(spark, sf_dir, "labels", "toxic"), "toxic")


_H32 = "CAST(('0x' || substr(md5('{seed}' || CAST({col} AS VARCHAR)), 1, 8)) AS BIGINT)"


@query("split_sizes",
       sql=f"""SELECT CAST({_H32.format(seed='42:', col='o_orderkey')} AS DOUBLE) < {0.2 * 2 ** 32!r} AS is_test,
  count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS id_sum FROM orders GROUP BY 1""")
def split_sizes(spark, sf_dir):
    """M1: md5-based 80/20 split of all orders (partitioning-independent), sizes and id sums."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey")
    return (o.select(is_test("o_orderkey").alias("is_test"), "o_orderkey").groupBy("is_test")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("id_sum")))


@query("fold_sizes",
       sql=f"""SELECT CAST({_H32.format(seed='42:fold:', col='o_orderkey')} % 3 AS INTEGER) AS fold,
  count(*) AS n FROM orders GROUP BY 1""")
def fold_sizes(spark, sf_dir):
    """3 hash folds over all orders."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey")
    return o.groupBy(fold_of("o_orderkey").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("split_exact",
       sql=f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_H32.format(seed='42:', col='o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
  SELECT r <= ceil(0.2 * n) AS is_test, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS id_sum FROM r GROUP BY 1""")
def split_exact(spark, sf_dir):
    """M1 with ``exact``: ceil(0.2 n) of all orders are test rows, sizes and id sums."""
    o = with_split(read_table(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", exact=True)
    return o.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("id_sum"))


@query("stratified_folds",
       sql=f"""WITH f AS (SELECT o_orderpriority, o_orderkey, ntile(3) OVER (PARTITION BY o_orderpriority ORDER BY {_H32.format(seed='42:fold:', col='o_orderkey')}, o_orderkey) - 1 AS fold FROM orders)
  SELECT o_orderpriority, CAST(fold AS INTEGER) AS fold, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS id_sum FROM f GROUP BY ALL""")
def stratified_folds(spark, sf_dir):
    """W3 stratified: 3 folds of all orders within every priority, sizes and id sums."""
    o = with_stratified_folds(read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", bucket_rows=500)
    return o.groupBy("o_orderpriority", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("id_sum"))


_SCALE_COLS = ["interet_maths", "heures_etude_soir", "heures_sommeil", "temps_ecrans_total", "score_equilibre"]


@query("scaled_features",
       sql=f"""{PREP}, st AS (SELECT {', '.join(f'avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}'
                                                 for c in _SCALE_COLS)} FROM feat)
SELECT id, {', '.join(f'CASE WHEN s_{c} = 0 THEN 0.0 ELSE (CAST({c} AS DOUBLE) - m_{c}) / s_{c} END AS {c}_z'
                      for c in _SCALE_COLS)} FROM feat, st""",
       doubles=[f"{c}_z" for c in _SCALE_COLS])
def scaled_features(spark, sf_dir):
    """M2: z-scores with the population std (constant column -> 0)."""
    df = S.population_scale(prepared_cohort(spark, sf_dir), _SCALE_COLS, suffix="_z")
    return df.select("id", *[f"{c}_z" for c in _SCALE_COLS])


_OH_COLS = ["classe", "activite_sportive"]


@query("one_hot",
       sql=f"{PREP} " + " UNION ALL ".join(
           f"SELECT id, '{c}' AS feature, CAST({c} AS VARCHAR) AS category, 1 AS indicator FROM feat WHERE {c} IS NOT NULL"
           for c in _OH_COLS))
def one_hot(spark, sf_dir):
    """M3 in sparse long form: the cells of the encoding that are 1."""
    return S.one_hot_long(prepared_cohort(spark, sf_dir), _OH_COLS)


def _impact_sql(src: str, bg: str) -> str:
    feats = [c for c in COHORT_WEIGHTS if c in
             ["heures_etude_soir", "interet_maths", "heures_jeux_video", "heures_reseaux_sociaux", "stress_total",
              "heures_sommeil"]]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {sql_str(K.TRANSLATIONS.get(c, c))} AS label, "
        f"avg(abs((CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM {bg})) * "
        f"CAST({float(COHORT_WEIGHTS[c])!r} AS DOUBLE))) AS mean_abs_impact FROM {src}" for c in feats)


@query("linear_impact", sql=f"{PREP} {_impact_sql('feat', 'feat')}",
       doubles=["mean_abs_impact"])
def linear_impact(spark, sf_dir):
    """M21 closed form: mean |w_j (x_j - mean_j)| per feature of the linear grade, translated."""
    return S.linear_impact(prepared_cohort(spark, sf_dir), COHORT_WEIGHTS)


@query("failure_impact",
       sql=f"{PREP}, fail AS (SELECT * FROM feat WHERE note_moyenne < 10) {_impact_sql('fail', 'feat')}",
       doubles=["mean_abs_impact"])
def failure_impact(spark, sf_dir):
    """M22 closed form: the same impacts over failing students only (F1), background = all students."""
    df = prepared_cohort(spark, sf_dir)
    return S.linear_impact(failing(df), COHORT_WEIGHTS, background=df)


_SCEN = [("sleep_8h", "8.0", "NULL", "NULL"), ("no_games", "NULL", "0.0", "NULL"),
         ("study_plus_1", "NULL", "NULL", "heures_etude_soir + 1.0")]
_APPLIED_COLS = ", ".join(
    "c.id, s.scenario" if c == "id" else
    "coalesce(s.o_sommeil, c.heures_sommeil) AS heures_sommeil" if c == "heures_sommeil" else
    "coalesce(s.o_jeux, c.heures_jeux_video) AS heures_jeux_video" if c == "heures_jeux_video" else
    "coalesce(s.o_etude, c.heures_etude_soir) AS heures_etude_soir" if c == "heures_etude_soir" else f"c.{c}"
    for c in RAW_ORDER)
_WHATIF_SQL = f"""{PREP},
scen AS ({' UNION ALL '.join(f"SELECT id, '{n}' AS scenario, CAST({a} AS DOUBLE) AS o_sommeil, CAST({b} AS DOUBLE) AS o_jeux, CAST({e} AS DOUBLE) AS o_etude FROM feat" for n, a, b, e in _SCEN)}),
applied AS (SELECT {_APPLIED_COLS} FROM scen s JOIN clean c ON s.id = c.id),
{feat_ctes('applied', 'wf')},
w0 AS (SELECT *, {grades_sql()} FROM wf),
w AS (SELECT *, {pred_mean_sql()} AS note_pred FROM w0)
SELECT id, scenario, score_equilibre, ratio_etude_ecrans, note_pred, {_BAND} AS band FROM w"""


@query("what_if_scenarios", sql=_WHATIF_SQL,
       doubles=["score_equilibre", "ratio_etude_ecrans", "note_pred"])
def what_if_scenarios(spark, sf_dir):
    """Three scenarios per student (sleep 8 h, no games, one more study hour), features
    recomputed and the linear grade rescored."""
    prep = prepared_cohort(spark, sf_dir)
    none = F.lit(None).cast("double")
    scen = prep.select("id", F.explode(F.array(
        F.struct(F.lit("sleep_8h").alias("scenario"), F.lit(8.0).alias("heures_sommeil"),
                 none.alias("heures_jeux_video"), none.alias("heures_etude_soir")),
        F.struct(F.lit("no_games").alias("scenario"), none.alias("heures_sommeil"),
                 F.lit(0.0).alias("heures_jeux_video"), none.alias("heures_etude_soir")),
        F.struct(F.lit("study_plus_1").alias("scenario"), none.alias("heures_sommeil"),
                 none.alias("heures_jeux_video"), (F.col("heures_etude_soir") + F.lit(1.0)).alias("heures_etude_soir")),
    )).alias("s")).select("id", "s.*")
    out = S.with_subject_grades(S.what_if(prep, scen), COHORT_WEIGHTS)
    return out.select("id", "scenario", "score_equilibre", "ratio_etude_ecrans", "note_pred",
                      X.band("note_pred").alias("band"))


@query("lookup_nation",
       sql="SELECT c_custkey, c_nationkey, n_name AS nation_name FROM customer "
           "LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_nation(spark, sf_dir):
    """Dictionary lookup of every customer's nation name (equi-join)."""
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return lookup(cust, "c_nationkey", nation, "n_nationkey", "n_name", out="nation_name", keep_unmatched=False)


_T = f"CAST({_H32.format(seed='42:', col='f.id')} AS DOUBLE) < {0.2 * 2 ** 32!r}"


@query("lookup_test_grades",
       sql=f"{PREP} SELECT r.id, {', '.join('r.' + g for g in COHORT_GRADES)} FROM feat f JOIN raw r ON f.id = r.id "
           f"WHERE {_T}",
       doubles=COHORT_GRADES)
def lookup_test_grades(spark, sf_dir):
    """J1 + M1: raw (un-imputed) grades of the test-split students, joined by id."""
    raw = raw_cohort(spark, sf_dir)
    return lookup_rows(with_split(prepare(raw)).where("is_test"), raw, COHORT_GRADES)


@query("failing_features",
       sql=f"{PREP} SELECT id, score_equilibre, ratio_etude_ecrans, stress_total FROM feat "
           f"WHERE id IN (SELECT id FROM raw WHERE note_moyenne < 10)",
       doubles=["score_equilibre", "ratio_etude_ecrans", "stress_total"])
def failing_features(spark, sf_dir):
    """J3 + F1: feature rows of students whose (raw) label is below 10, by semi-join."""
    raw = raw_cohort(spark, sf_dir)
    feats = prepare(raw).select("id", "score_equilibre", "ratio_etude_ecrans", "stress_total")
    labels = raw.select("id", K.TARGET_REG)
    return aligned_mask(feats, labels, F.col(K.TARGET_REG) < K.PASS_THRESHOLD)


@query("passing_count",
       sql=f"{PREP} SELECT count(*) AS n_passed FROM feat WHERE note_moyenne >= 10")
def passing_count(spark, sf_dir):
    """students at or above the threshold."""
    from ..operators.cohort import above_threshold
    return above_threshold(prepared_cohort(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_passed"))


@query("class_options",
       sql=f"{PREP} SELECT DISTINCT CAST(classe AS VARCHAR) AS option FROM feat "
           f"WHERE classe IS NOT NULL AND CAST(classe AS VARCHAR) <> ''")
def class_options(spark, sf_dir):
    """scenario options for a text feature (non-empty distinct values)."""
    return non_empty_options(prepared_cohort(spark, sf_dir), "classe")


_CLASS_NAMES = list(K.CLASS_CODES)
_NAMED = " ".join(f"WHEN {i} THEN {sql_str(n)}" for i, n in enumerate(_CLASS_NAMES))
_CODED = " ".join(f"WHEN {i} THEN {sql_str(K.CLASS_CODES[n])}" for i, n in enumerate(_CLASS_NAMES))


@query("recode_labels",
       sql=f"{BASE} SELECT id, CASE id % {len(_CLASS_NAMES) + 1} {_NAMED} ELSE classe END AS classe, "
           f"CASE id % {len(_CLASS_NAMES) + 1} {_CODED} ELSE classe END AS classe_code FROM raw")
def recode_labels(spark, sf_dir):
    """Class names to codes; every eighth student keeps a market segment, which no code replaces."""
    raw = raw_cohort(spark, sf_dir, materialize=False)
    names = F.array(*[F.lit(n) for n in _CLASS_NAMES])
    named = raw.select("id", F.coalesce(F.get(names, (F.col("id") % F.lit(len(_CLASS_NAMES) + 1)).cast("int")), F.col("classe")).alias("classe"))
    return named.select("id", "classe", X.recode("classe").alias("classe_code"))


_LABELS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {sql_str(K.TRANSLATIONS.get(c, c))} AS label, count(*) FILTER (WHERE {c} IS NULL) AS nulls "
    f"FROM feat" for c in RAW_ORDER + ["heure_coucher_num", "heure_lever_num", "temps_ecrans_total",
                                       "score_equilibre", "ratio_etude_ecrans", "stress_total",
                                       "indice_motivation", "reussite"])


@query("feature_labels", sql=f"{PREP} {_LABELS_SQL}")
def feature_labels(spark, sf_dir):
    """Readable label for every prepared column (with its NULL count after cleaning)."""
    nc = null_counts(prepared_cohort(spark, sf_dir))
    return nc.select("column", X.translate_name(F.col("column")).alias("label"), "nulls")
