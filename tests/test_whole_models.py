"""Trees of whole models grown by single tasks: boosted trees against the joint loop and ``GBTRegressor``,
forests against ``RandomForestClassifier``, the refits as Spark's own models."""
import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from gradelens.ml import boosting as B
from gradelens.ml import forest as R
from gradelens.ml import search as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = np.c_[rng.normal(size=(1500, 3)), rng.integers(0, 4, 1500), rng.integers(0, 2, 1500)]
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) * x[:, 3] + rng.normal(scale=0.2, size=1500)
    df = spark.createDataFrame([(i, *map(float, r), float(v), int(v > 0.6), 1.0 + int(v > 0.6), i % 3) for i, (r, v) in enumerate(zip(x, y))],
                               "key long, a double, b double, c double, d double, e double, value double, class int, w double, fold int")
    return VectorAssembler(inputCols=list("abcde"), outputCol="x").transform(df).repartition(3).cache()


def _jobs(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(name))


def test_models_boosted_by_single_tasks_are_those_of_the_joint_loop(spark, data, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 400)
    rows = data.select("x", F.col("value").alias("label"), "fold")

    def models():
        return [B.Boosted(f, depth, rate, rounds) for f in range(2) for depth, rate, rounds in ((2, 0.1, 12), (4, 0.2, 9), (6, 0.1, 5))]

    got, jobs = _jobs(spark, "alone", lambda: B.boost_many(rows, {0: "x", 1: "x"}, models()))
    assert jobs <= 12                                          # 48 levels: before, a job for each
    monkeypatch.setattr(B, "ALONE_ROWS", 0)
    want = B.boost_many(rows, {0: "x", 1: "x"}, models())
    for a, b in zip(got, want):
        assert len(a.mse) == a.rounds and a.mse == pytest.approx(b.mse, rel=1e-9)


@pytest.mark.parametrize("alone", [True, False])
def test_a_boosted_refit_is_a_model_of_spark(spark, data, monkeypatch, tmp_path, alone):
    plain = GBTRegressor(featuresCol="x", labelCol="value", maxIter=15, maxDepth=4, stepSize=0.2, seed=42)
    want, chain = _jobs(spark, f"plain{alone}", lambda: plain.fit(data))
    if not alone:
        monkeypatch.setattr(B, "ALONE_ROWS", 0)
    got, jobs = _jobs(spark, f"refit{alone}", lambda: B.fit_boosted(data, plain))
    assert isinstance(got, GBTRegressionModel) and got.getNumTrees == 15 and got.treeWeights == want.treeWeights
    assert not alone or jobs < chain / 2
    a, b = (np.array([r[0] for r in m.transform(data).orderBy("key").select("prediction").collect()]) for m in (got, want))
    assert a == pytest.approx(b, abs=1e-9) and got.totalNumNodes == want.totalNumNodes
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-4)
    assert got.getMaxDepth() == 4 and got.getMaxIter() == 15
    got.write().save(str(tmp_path / "m"))
    again = GBTRegressionModel.load(str(tmp_path / "m"))
    assert [r[0] for r in again.transform(data).orderBy("key").select("prediction").collect()] == a.tolist()


def test_forests_of_single_tasks_score_like_those_of_spark(spark, data, monkeypatch):
    settings = [(40, 3, 1), (40, 8, 2), (60, 30, 1)]
    forests = [R.Forest(f, *s, 42) for s in settings for f in range(3)]
    rows = data.select("x", F.col("class").alias("label"), "fold", "key")
    got, jobs = _jobs(spark, "forests", lambda: R.forest_accuracies(rows, {f: "x" for f in range(3)}, forests, [1.0, 2.0]))
    assert jobs <= 8                                           # Spark: a job a level of every forest
    monkeypatch.setattr(R, "CHUNK_TREES", 7)
    assert R.forest_accuracies(rows.repartition(5), {f: "x" for f in range(3)}, forests, [1.0, 2.0]) == got
    for k, (trees, depth, least) in enumerate(settings):
        want = []
        for f in range(3):
            m = RandomForestClassifier(featuresCol="x", labelCol="class", weightCol="w", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=1).fit(data.where(F.col("fold") != f))
            want.append(m.transform(data.where(F.col("fold") == f)).agg(F.avg((F.col("prediction") == F.col("class")).cast("int"))).first()[0])
        assert np.mean(got[3 * k:3 * k + 3]) == pytest.approx(np.mean(want), abs=0.02)


def test_a_forest_refit_is_a_model_of_spark(spark, data):
    rows = data.select("x", F.col("class").alias("label"), "fold", "key")
    plain = RandomForestClassifier(featuresCol="x", labelCol="class", weightCol="w", numTrees=30, maxDepth=6, minInstancesPerNode=2, seed=42)
    got, want = R.fit_forest(rows, "x", plain, [1.0, 2.0]), plain.fit(data)
    assert isinstance(got, RandomForestClassificationModel) and got.getNumTrees == 30 and got.numClasses == 2 and got.getMaxDepth() == 6
    a, b = (np.array([r[0][1] for r in m.transform(data).orderBy("key").select("probability").collect()]) for m in (got, want))
    assert np.mean(abs(a - b)) < 0.05 and np.mean((a >= 0.5) == (b >= 0.5)) > 0.97
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=0.06)
    assert got.totalNumNodes == pytest.approx(want.totalNumNodes, rel=0.1)


def test_a_tree_is_that_of_a_plain_loop():
    """One column: against a recursion over histograms of one node at a time, few and many rows a node."""
    rng = np.random.default_rng(4)
    bins, y = rng.integers(0, 32, (3, 400)).astype(np.uint8), rng.integers(0, 3, 400)
    drawn, weights = rng.poisson(1.0, 400), np.array([1.0, 2.0, 0.5])
    for depth, least in ((3, 1), (12, 3)):
        tree = R.grow(bins[:1], y, drawn, weights, depth, least, rng)

        def plain(rows, level):
            c = np.array([drawn[rows][y[rows] == k].sum() for k in range(3)], float)
            total = (c * weights).sum()
            best = (1e-10 * total, None)
            if level < depth and (c > 0).sum() > 1:
                for b in range(32):
                    left = bins[0, rows] <= b
                    l = np.array([drawn[rows][left & (y[rows] == k)].sum() for k in range(3)], float)
                    r = c - l
                    if l.sum() >= least and r.sum() >= least:
                        gain = ((l * weights) ** 2).sum() / (l * weights).sum() + ((r * weights) ** 2).sum() / (r * weights).sum() - ((c * weights) ** 2).sum() / total
                        if gain > best[0] + 1e-9:
                            best = (gain, b)
            told = int((c * weights).argmax())
            share = np.zeros((3, 400))
            if best[1] is not None:
                at = bins[0, rows] <= best[1]
                l_leaf, l_told, l_share = plain(rows[at], level + 1)
                r_leaf, r_told, r_share = plain(rows[~at], level + 1)
                if not (l_leaf and r_leaf and l_told == r_told):
                    return False, told, l_share + r_share
            share[:, rows] = (c * weights / total)[:, None]
            return True, told, share

        assert R.votes(tree, bins[:1], weights) == pytest.approx(plain(np.arange(400), 0)[2])


def test_searches_use_whole_models_beyond_few_rows(spark, data, monkeypatch):
    monkeypatch.setattr(S, "SPLIT_ROWS", 500)
    monkeypatch.setattr(S, "_forests_by_spark", None)
    train = data.drop("x", "w").withColumnRenamed("key", "id")
    res = S.rf_search(train.drop("value"), "class", ["id"], grid={"numTrees": [12], "maxDepth": [3, None], "minSamplesSplit": [2]})
    assert len(res.cv_scores) == 2 and all(0.8 < s <= 1 for _, s in res.cv_scores)
    assert res.model.transform(train).agg(F.avg((F.col("prediction") == F.col("class")).cast("int"))).first()[0] > 0.85


def test_a_family_is_scored_once_for_all_choices(monkeypatch):
    from gradelens.plans import catalogue_models as C
    scored, kept = [], {}

    class Frame:
        def where(self, _):
            return self

    def once(spark, sf_dir, *rest, make):
        if rest not in kept:
            kept[rest] = make()
        return kept[rest]

    monkeypatch.setattr(C, "frame", lambda spark, sf_dir: Frame())
    monkeypatch.setattr(C, "searched", lambda spark, sf_dir, family: family)
    monkeypatch.setattr(C, "test_metrics", lambda result, test, label: scored.append(result) or {"family": result})
    monkeypatch.setattr(C, "_once", once)
    for families in (None, C.REG_FAMILIES, C.CLF_FAMILIES):
        assert [m["family"] for m in C.metrics_rows(None, "", families)] == (families or C.REG_FAMILIES + C.CLF_FAMILIES)
    assert sorted(scored) == sorted(C.FAMILIES)
