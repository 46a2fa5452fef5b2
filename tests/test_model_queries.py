"""Values of the queries about fitted models, which no SQL can know, against plain loops over the fitted models."""
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gradelens.functions import constants as K
from gradelens.ml import gradient as G
from gradelens.ml import scoring as SC
from gradelens.plans import catalogue_models as C
from gradelens.plans import registry
from gradelens.plans.report import report_text
from gradelens.plans.training import excluded_columns, fit_subject_models, model_frame, train_subject_models, with_observed
from gradelens.plans.prepare import prepare, raw_cohort
from gradelens.ml.search import fit_point

from conftest import SF_SMOKE, SMALL_GRIDS

pytestmark = pytest.mark.usefixtures("small_searches")


def _rows(spark, name):
    return registry.queries()[name](spark, SF_SMOKE).collect()


def _walk(spark, trees, path):
    """A prediction function of a saved tree ensemble, from its node table."""
    trees.write().overwrite().save(path)
    nodes = {(r["treeID"], r["nodeData"]["id"]): r["nodeData"] for r in spark.read.parquet(f"{path}/data").collect()}
    weights = trees.treeWeights

    def one(tree, x):
        node = nodes[tree, 0]
        while node["leftChild"] >= 0:
            split = node["split"]
            v, held = x[split["featureIndex"]], split["leftCategoriesOrThreshold"]
            left = v <= held[0] if split["numCategories"] == -1 else v in held
            node = nodes[tree, node["leftChild"] if left else node["rightChild"]]
        return node["prediction"]

    return lambda x: sum(w * one(t, x) for t, w in enumerate(weights))


def _inputs(model, df, *cols):
    """The vectors that the last stage of a pipeline gets."""
    for stage in model.stages[:-1]:
        df = stage.transform(df)
    return df.select("id", vector_to_array("selected").alias("x"), *cols).collect()


def test_searches_score_every_candidate(spark):
    for name, family in (("search_gbt_regression", "gbt_reg"), ("search_svm_classification", "svc")):
        rows = _rows(spark, name)
        assert len(rows) == sum(1 for _ in C.searched(spark, SF_SMOKE, family).cv_scores) and sum(r["chosen"] for r in rows) == 1
        best = next(r for r in rows if r["chosen"])
        assert np.isfinite([r["cv_score"] for r in rows]).all() and best["cv_score"] == pytest.approx(max(r["cv_score"] for r in rows))


def test_subject_predictions_by_walking_the_trees(spark, tmp_path):
    rows = {r["id"]: r for r in _rows(spark, "predict_all")}
    frame = C.frame(spark, SF_SMOKE)
    assert len(rows) == frame.count()
    for subject, result in C.subjects(spark, SF_SMOKE).items():
        walk = _walk(spark, result.model.stages[-1], str(tmp_path / subject))
        label = "Prédit_" + subject.replace("note_", "")
        for r in _inputs(result.model, frame.where("id % 5 = 0")):
            assert rows[r["id"]][label] == pytest.approx(walk(r["x"]), abs=1e-5)
    for r in rows.values():
        if r["note_moyenne"] is not None:
            assert r["Écart"] == pytest.approx(r["Note Prédite (Moy)"] - r["note_moyenne"], abs=2e-6)


def test_gradient_models_by_a_forward_pass(spark):
    frame = C.frame(spark, SF_SMOKE).where("id % 5 = 0")
    for family in ("mlp_reg", "svr", "mlp_clf", "svc"):
        model = C.searched(spark, SF_SMOKE, family).model
        last = model.stages[-1]
        got = {r["id"]: r for r in model.transform(frame).collect()}
        theta, space = np.array(last.getOrDefault(last.weights)), last.space
        for r in _inputs(model, frame):
            f = G.forward(last.spec, theta, np.array([r["x"]]), space)[0]
            if family in ("mlp_reg", "svr"):
                assert got[r["id"]]["prediction"] == pytest.approx(f * last.getOrDefault(last.yStd) + last.getOrDefault(last.yMean))
            else:
                z = f if family == "mlp_clf" else last.getOrDefault(last.plattA) * f + last.getOrDefault(last.plattB)
                assert got[r["id"]]["probability"][1] == pytest.approx(1 / (1 + np.exp(-z)))


def test_metric_table_and_choice(spark):
    test = C.frame(spark, SF_SMOKE).where("is_test")
    table = {r["family"]: r for r in _rows(spark, "model_metrics")}
    assert len(table) == 6
    for family, row in table.items():
        label = C._label(family)
        rows = SC.predict(C.searched(spark, SF_SMOKE, family).model, test, "p").select(label, "p").where(F.col(label).isNotNull()).collect()
        y, p = np.array([float(r[0]) for r in rows]), np.array([r[1] for r in rows])
        if row["task"] == "regression":
            assert row["r2"] == pytest.approx(1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-5)
            assert row["mae"] == pytest.approx(np.abs(p - y).mean(), abs=1e-5) and row["rmse"] == pytest.approx(np.sqrt(((p - y) ** 2).mean()), abs=1e-5)
        else:
            assert row["accuracy"] == pytest.approx(100 * (p == y).mean(), abs=1e-5)
    best = {r["task"]: r for r in _rows(spark, "best_models")}
    for task, key in (("regression", "r2"), ("classification", "accuracy")):
        scores = {f: r[key] for f, r in table.items() if r["task"] == task}
        assert best[task]["score"] == pytest.approx(max(scores.values()), abs=1e-5) and scores[best[task]["family"]] == max(scores.values())


def test_probabilities_bands_and_flags(spark):
    frame = C.frame(spark, SF_SMOKE)
    clf, reg = C.best_model(spark, SF_SMOKE, "classification").model, C.best_model(spark, SF_SMOKE, "regression").model
    want = {r["id"]: 100 * r["probability"][1] for r in clf.transform(frame.where("is_test")).select("id", "probability").collect()}
    got = {r["id"]: r["proba_reussite"] for r in _rows(spark, "pass_probability")}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-5) for i in want)
    rows = _rows(spark, "what_if_models")
    assert len(rows) == 2 * frame.count()
    for r in rows:
        assert r["band"] == ("green" if r["note_predite"] >= 14 else "orange" if r["note_predite"] >= 10 else "red")
        assert bool(r["at_risk"]) == (r["proba_reussite"] < 60 or r["note_predite"] < 10)
    slept = frame.withColumn("heures_sommeil", F.lit(8.0))
    again = SC.what_if_predict(frame, frame.select("id", F.lit("s").alias("scenario"), F.lit(8.0).alias("heures_sommeil")), reg, clf,
                               feature_cols=[c for cols in C.best_model(spark, SF_SMOKE, "regression").feature_cols for c in cols])
    notes = {r["id"]: r["note_predite"] for r in again.collect()}
    assert slept.count() == len(notes) and all(r["note_predite"] == pytest.approx(notes[r["id"]], abs=1e-5) for r in rows if r["scenario"] == "sleep_8h")


def test_report_rows_and_text(spark):
    rows = _rows(spark, "report_rows")
    table = {r["family"]: r for r in _rows(spark, "model_metrics")}
    scores = [r for r in rows if r["section"] in ("regression", "classification")]
    assert len(scores) == 3 * 3 + 3 * 4 and all(r["value"] == pytest.approx(table[r["note"]][r["key"]], abs=1e-6) for r in scores)
    kept = [r["key"] for r in sorted((r for r in rows if r["section"] == "features"), key=lambda r: r["position"])]
    assert kept == [r["feature"] for r in sorted(_rows(spark, "selected_features"), key=lambda r: r["position"]) if r["kept"]]
    impact = {r["label"]: r["mean_abs_impact"] for r in _rows(spark, "shapley_impact")}
    assert {r["key"]: r["value"] for r in rows if r["section"] == "impact"} == pytest.approx(impact, abs=1e-6)
    cohort = [tuple(r) for r in _rows(spark, "report_cohort")]
    assert sorted(map(str, cohort)) == sorted(str(tuple(r)) for r in rows if r["section"] in ("cohort", "subjects"))
    text = "\n".join(r["text"] for r in sorted(_rows(spark, "report_markdown"), key=lambda r: r["line"]))
    for r in rows:
        if r["section"] == "features":
            assert f"`{r['key']}`" in text
    assert text.count("(chosen)") == 2 and "What weighs most" in text
    empty = report_text(registry.queries()["report_rows"](spark, SF_SMOKE).where("false"))
    assert "0 students" in empty


def test_subject_models_share_their_matrix(spark):
    raw = raw_cohort(spark, SF_SMOKE)
    # the selector's forest draws its rows by partition: one partition makes the two ways comparable
    frame = with_observed(model_frame(prepare(raw)), raw, ["note_maths", "note_francais"]).coalesce(1).sortWithinPartitions("id").cache()
    params = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.2}
    got = fit_subject_models(frame, ["note_maths", "note_francais"], excluded_columns(frame), params)
    want = train_subject_models(frame, ["note_maths", "note_francais"], excluded_columns(frame), fit=lambda *a: fit_point(*a, params))
    for subject in got:
        a = {r["id"]: r["prediction"] for r in got[subject].model.transform(frame).collect()}
        b = {r["id"]: r["prediction"] for r in want[subject].model.transform(frame).collect()}
        assert np.mean([abs(a[i] - b[i]) for i in a]) < 0.05       # bins of equal rows at another scale, categories of all rows
        assert np.median([abs(a[i] - b[i]) for i in a]) < 1e-6


def test_classifiers_have_stratified_folds(spark):
    frame = C.frame(spark, SF_SMOKE)
    sizes = {}
    for r in frame.groupBy("is_test", K.TARGET_CLF, "fold_class").count().collect():
        sizes.setdefault((r[0], r[1]), []).append(r["count"])
    assert all(max(s) - min(s) <= 1 and len(s) == 3 for s in sizes.values())
    assert set(SMALL_GRIDS) == set(C.FAMILIES)


def test_families_of_short_jobs_are_not_searched_beside_others(monkeypatch):
    """Their many short jobs would wait for the perceptrons' long tasks."""
    import threading
    import time
    running, beside, lock = set(), {}, threading.Lock()

    def search(spark, sf_dir, family):
        with lock:
            running.add(family)
            for f in running:
                beside.setdefault(f, set()).update(running)
        time.sleep(0.1)
        with lock:
            running.discard(family)
        return family

    class Frame:
        def where(self, _):
            return self

    monkeypatch.setattr(C, "frame", lambda spark, sf_dir: Frame())
    monkeypatch.setattr(C, "searched", search)
    monkeypatch.setattr(C, "test_metrics", lambda result, test, label: {"family": result})
    monkeypatch.setattr(C, "_once", lambda spark, sf_dir, *rest, make: make())
    families = C.REG_FAMILIES + C.CLF_FAMILIES
    assert [m["family"] for m in C.metrics_rows(None, "")] == families
    assert all(beside[f] == {f} for f in families if not f.startswith("mlp"))
    assert beside["mlp_reg"] == beside["mlp_clf"] == {"mlp_reg", "mlp_clf"}
    assert [m["family"] for m in C.metrics_rows(None, "", C.CLF_FAMILIES)] == C.CLF_FAMILIES
