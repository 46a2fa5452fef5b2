"""The joint boosting loop against ``GBTRegressor``, model by model."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from gradelens.ml import boosting as B


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=(600, 2)), rng.integers(0, 4, 600)]
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) * x[:, 2] + rng.normal(scale=0.1, size=600)
    df = spark.createDataFrame([(*map(float, r), float(v), i % 3) for i, (r, v) in enumerate(zip(x, y))], "a double, b double, c double, label double, fold int")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(df).cache()


def _models():
    return [B.Boosted(f, depth, rate, rounds) for f in range(2) for depth, rate, rounds in ((2, 0.1, 6), (4, 0.2, 3))]


def test_errors_are_those_of_single_fits(spark, data, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)              # several blocks
    monkeypatch.setattr(B, "CHECKPOINT_TREES", 2)
    sc = spark.sparkContext
    sc.setJobGroup("joint", "joint")
    try:
        got = B.boost_many(data, {0: "x", 1: "x"}, _models())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    for m in got:
        fit = GBTRegressor(featuresCol="x", labelCol="label", maxIter=m.rounds, maxDepth=m.depth, stepSize=m.rate, seed=1).fit(data.where(F.col("fold") != m.held_out))
        assert m.mse == pytest.approx(fit.evaluateEachIteration(data.where(F.col("fold") == m.held_out), "squared"), rel=0.02)
    # one job a level for all models (3 trees of 4 levels, 3 of 2), the rest: blocks, thresholds, checkpoints, last errors
    assert len(sc.statusTracker().getJobIdsForGroup("joint")) <= 3 * 4 + 3 * 2 + 20


def test_constant_labels_and_empty_data(spark, data):
    same = B.boost_many(data.withColumn("label", F.lit(2.0)), {0: "x"}, [B.Boosted(0, 3, 0.1, 3)])
    assert same[0].mse == pytest.approx([0.0, 0.0, 0.0], abs=1e-12)
    assert B.boost_many(data.where("false"), {0: "x"}, [B.Boosted(0, 3, 0.1, 3)])[0].mse == []


def test_thresholds():
    assert B.thresholds(np.array([1.0, 1.0, 3.0, 2.0, np.nan])).tolist() == [1.5, 2.5]
    cuts = B.thresholds(np.arange(3200.0))
    assert len(cuts) == 31 and np.diff(cuts) == pytest.approx(np.full(30, 100.0), abs=1.0)
