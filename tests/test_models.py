"""Model smoke and property tests (the reference's model tests, plus Shapley and persistence)."""
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gradelens.ml.explain import shapley_values
from gradelens.ml.gradient import Spec, forward, loss_grad, init_params
from gradelens.ml.persist import load_models, save_models
from gradelens.ml import gradient as G
from gradelens.ml.search import fit_point, gbt_search, rf_search, sample_grid, spark_search, train_family
from gradelens.plans.prepare import prepare, prepared_cohort, raw_cohort
from gradelens.plans.training import excluded_columns, model_frame, train_subject_models, with_observed
from gradelens.functions import constants as K

from conftest import SF_SMOKE


@pytest.fixture(scope="module")
def frame(spark):
    return model_frame(prepared_cohort(spark, SF_SMOKE)).cache()


def test_sample_grid_sizes():
    assert len(sample_grid(K.GBT_GRID)) == 10 and len(sample_grid(K.SVC_GRID)) == 6
    assert sample_grid(K.MLP_GRID) == sample_grid(K.MLP_GRID)


@pytest.mark.parametrize("family", ["mlp_reg", "svr"])
def test_gradient_check(family):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    spec = Spec(family, hidden=(4,), activation="tanh", kernel="linear")
    th = init_params(spec, 3) + rng.normal(scale=0.1, size=init_params(spec, 3).shape)
    _, g = loss_grad(spec, th, x, y, 3)
    eps, i = 1e-6, 2
    e = np.zeros_like(th); e[i] = eps
    num = (loss_grad(spec, th + e, x, y, 3)[0] - loss_grad(spec, th - e, x, y, 3)[0]) / (2 * eps)
    assert g[i] == pytest.approx(num, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("family,label", [("mlp_reg", "note_moyenne"), ("mlp_clf", "reussite"),
                                          ("svc", "reussite")])
def test_gradient_families_predict(spark, frame, family, label):
    train, test = frame.where("not is_test"), frame.where("is_test")
    excl = [c for c in excluded_columns(frame) if c != label]
    res = train_family(train, label, family, excl, n=2, steps=30)
    out = res.model.transform(test)
    preds = [r["prediction"] for r in out.select("prediction").collect()]
    assert len(preds) == test.count() and all(np.isfinite(preds))
    if label == "reussite":
        assert set(preds) <= {0.0, 1.0}
        probs = out.select("probability").collect()
        assert all(len(r[0]) == 2 and abs(sum(r[0]) - 1) < 1e-9 for r in probs)


def test_shapley_sum_rule_linear(spark):
    rows = [(i, float(i % 7), float((3 * i) % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("y", F.col("a") * 2 - F.col("b"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                             LinearRegression(labelCol="y")]).fit(df)
    bg = df.where("id = 3")                       # one background row: exact values
    phi = shapley_values(model, df.where("id < 10"), bg, ["a", "b"], n_perm=4)
    got = {(r["id"], r["feature"]): r["phi"] for r in phi.collect()}
    z = bg.first()
    for i in range(10):
        x = df.where(f"id = {i}").first()
        assert got[(i, "a")] == pytest.approx(2 * (x["a"] - z["a"]), abs=1e-6)
        assert got[(i, "b")] == pytest.approx(-(x["b"] - z["b"]), abs=1e-6)


def test_save_load_round_trip(spark, frame, tmp_path):
    train = frame.where("not is_test")
    excl = [c for c in excluded_columns(frame) if c != "note_moyenne"]
    res = train_family(train, "note_moyenne", "mlp_reg", excl, n=1, steps=5)
    path = str(tmp_path / "bundle")
    save_models(spark, path, {"nn_reg": res.model}, {"feature_columns": ["x"]})
    models, subjects, man = load_models(spark, path)
    a = [r[0] for r in res.model.transform(frame).select("prediction").collect()]
    b = [r[0] for r in models["nn_reg"].transform(frame).select("prediction").collect()]
    assert a == pytest.approx(b) and man["feature_columns"] == ["x"]
    assert load_models(spark, str(tmp_path / "missing")) is False


def test_parameters_do_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(G, "SHARD_ROWS", 40)               # several shards
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=3)], float(rng.normal()), i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, fold int").withColumn("key", F.xxhash64("id"))
    specs = [Spec("mlp_reg", hidden=(5,)), Spec("svr", kernel="rbf", epsilon=0.1, C=1.0)]
    got = []
    for n in (4, 8):
        data = df.repartition(n).cache()
        jobs = G.train_many(data, specs, [None, 0], steps=10)
        assert data.storageLevel.useMemory                 # the caller's cache stays
        got.append(np.concatenate([j.theta for j in jobs]))
        data.unpersist()
    assert got[0] == pytest.approx(got[1], abs=1e-9)


def test_subject_models_learn_observed_grades(spark):
    raw = raw_cohort(spark, SF_SMOKE)
    fr = with_observed(model_frame(prepare(raw)), raw, ["note_maths"])
    seen = []

    def fit(train, label, family, exclude):
        seen.append((train.count(), label, set(exclude) >= {"note_maths", "note_moyenne"}))
        return None

    train_subject_models(fr, ["note_maths"], excluded_columns(fr), fit=fit)
    ids = fr.where("not is_test").select("id")
    want = raw.where("note_maths is not null").join(ids, "id", "left_semi").count()
    assert seen == [(want, "note_maths__observed", True)] and want < ids.count()


def test_tree_searches_equal_the_plain_cross_validation(spark, frame):
    # the forests draw their rows by partition: with one partition both ways draw the same
    train = frame.where("not is_test").coalesce(1).sortWithinPartitions("id").cache()
    for search, family, label, grid in ((gbt_search, "gbt_reg", "note_moyenne", {"maxIter": [2, 4], "maxDepth": [2], "stepSize": [0.1]}),
                                        (rf_search, "rf_clf", "reussite", {"numTrees": [3], "maxDepth": [2, 3], "minSamplesSplit": [2]})):
        excl = [c for c in excluded_columns(frame) if c != label]
        a, b = search(train, label, excl, grid=grid), spark_search(train, label, family, excl, grid=grid)
        assert [c for c, _ in a.cv_scores] == [c for c, _ in b.cv_scores]
        assert [s for _, s in a.cv_scores] == pytest.approx([s for _, s in b.cv_scores], abs=0.01)


def test_shapley_sum_rule_on_trees_with_a_large_background(spark, frame):
    train, test = frame.where("not is_test"), frame.where("is_test")
    excl = [c for c in excluded_columns(frame) if c != "note_moyenne"]
    res = fit_point(train, "note_moyenne", "gbt_reg", excl, {"maxIter": 5, "maxDepth": 3, "stepSize": 0.2})
    feats = list(res.feature_cols[0]) + list(res.feature_cols[1])
    assert train.count() > 20
    one = train.limit(1).cache()
    phi = shapley_values(res.model, test, one, feats, n_perm=3)
    sums = {r["id"]: r["s"] for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    base = res.model.transform(one).first()["prediction"]
    for r in res.model.transform(test).select("id", "prediction").collect():
        assert sums[r["id"]] == pytest.approx(r["prediction"] - base, abs=1e-6)
    assert shapley_values(res.model, test, train, feats, n_perm=2).count() == test.count() * len(feats)
