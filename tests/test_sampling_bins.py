"""Exact split, stratified folds, automatic bins, row numbers, kernel Shapley values."""
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from gradelens.ml import explain as E
from gradelens.operators import profile as P
from gradelens.operators import sampling as S


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 1001])
def test_exact_split_sizes(spark, n):
    df = spark.range(n)
    for parts in (1, 7):
        train, test = S.train_test_split(df.repartition(parts), exact=True)
        ids = {r["id"] for r in test.collect()}
        assert len(ids) == math.ceil(0.2 * n) and train.count() == n - len(ids)
        by_hash = [r["id"] for r in df.orderBy(S.hash32("id", "42:"), "id").collect()]
        assert ids == set(by_hash[:len(ids)])


def test_exact_split_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None,)] * 5 + [(1,)] * 4 + [(i,) for i in range(2, 13)], "id long")
    train, test = S.train_test_split(df, exact=True)
    got = [r["id"] for r in test.collect()]
    assert None not in got and got.count(1) in (0, 4) and len(got) >= 4 and train.count() + len(got) == 20
    assert S.train_test_split(df.where("id IS NULL"), exact=True)[1].count() == 0


@pytest.mark.parametrize("bucket_rows", [10_000, 3])
def test_stratified_folds(spark, bucket_rows):
    rows = [(i, ["a", "b", None][(i * i) % 3], i % 7 == 0) for i in range(400)] + [(1000, "alone", True), (1001, "pair", True), (1002, "pair", True)]
    df = spark.createDataFrame(rows, "id long, label string, is_test boolean")
    got = [{r["id"]: r["fold"] for r in S.with_stratified_folds(df.repartition(p), ["is_test", "label"], bucket_rows=bucket_rows).collect()} for p in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    strata = {}
    for i, label, test in rows:
        strata.setdefault((test, label), []).append(got[0][i])
    for folds in strata.values():
        sizes = [folds.count(f) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert S.with_stratified_folds(df.where("false"), ["label"]).count() == 0


@pytest.mark.parametrize("lo,hi,most", [(0.0, 1.0, 25), (-3.2, 17.9, 25), (0.001, 0.0017, 10), (1e6, 9e9, 30), (5.0, 5.0, 25), (-1.0, 0.0, 3), (99.0, 101.0, 2)])
def test_round_widths(lo, hi, most):
    assert P.nice_width(-1.0, 1.0, 1) == 1.0 or P.nice_width(-1.0, 1.0, 1) == 2.0
    w = P.nice_width(lo, hi, most)
    m = w / 10 ** math.floor(math.log10(w) + 1e-9)
    assert min(abs(m - x) for x in (1, 2, 5)) < 1e-6
    assert math.floor(hi / w) - math.floor(lo / w) + 1 <= most
    if hi > lo:                                            # the next smaller round width needs more buckets
        smaller = w / 2 if round(m) in (1, 2) else w / 2.5
        assert math.floor(hi / smaller) - math.floor(lo / smaller) + 1 > most


def test_automatic_bins(spark):
    df = spark.createDataFrame([(v,) for v in (-0.5, 0.0, 0.1, 0.1, 3.0, None)], "v double")
    got = P.auto_histogram(df, "v", 5).orderBy("bucket").collect()
    assert [(r["lower"], r["upper"], r["count"]) for r in got] == [(-1.0, 0.0, 1), (0.0, 1.0, 3), (1.0, 2.0, 0), (2.0, 3.0, 0), (3.0, 4.0, 1)]
    assert P.auto_histogram(df.where("v IS NULL"), "v").count() == 0


def test_row_numbers_have_no_gap(spark):
    df = spark.range(1000).repartition(13)
    rows, n = E.numbered(df)
    assert n == 1000 and sorted(r["__b"] for r in rows.collect()) == list(range(1000)) and rows.columns == ["id", "__b"]
    assert E.numbered(df.where("false"))[1] == 0


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    y = x[:, 0] * x[:, 1] + np.maximum(x[:, 2], 0) * 2 - x[:, 3] + 0.5 * x[:, 4] * x[:, 5] * x[:, 6]
    names = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, " + ", ".join(f"{c} double" for c in names) + ", y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="f"), GBTRegressor(featuresCol="f", labelCol="y", maxIter=8, maxDepth=4, seed=1)]).fit(df)
    return model, df.cache(), names


def _score(spark, model, names, table):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(table)], "i long, " + ", ".join(f"{c} double" for c in names))
    return np.array([r["prediction"] for r in model.transform(df).orderBy("i").collect()])


def test_kernel_shapley_equals_all_coalitions(spark, fitted):
    model, df, names = fitted
    bg, rows = df.where("id >= 290"), df.where("id < 4")
    got = {(r["id"], r["feature"]): r["phi"] for r in E.kernel_shapley(model, rows, bg, names, n_background=10).collect()}
    z = np.array([[r[c] for c in names] for r in bg.collect()])
    subsets = [s for k in range(9) for s in combinations(range(8), k)]
    for r in rows.collect():
        x = np.array([r[c] for c in names])
        table = np.repeat(z[None], len(subsets), 0).copy()
        for i, s in enumerate(subsets):
            table[i][:, list(s)] = x[list(s)]
        v = dict(zip(subsets, _score(spark, model, names, table.reshape(-1, 8)).reshape(len(subsets), -1).mean(1)))
        for j, name in enumerate(names):
            want = sum(math.factorial(len(s)) * math.factorial(7 - len(s)) / math.factorial(8) * (v[tuple(sorted((*s, j)))] - v[s]) for s in subsets if j not in s)
            assert got[r["id"], name] == pytest.approx(want, abs=1e-8)
        assert sum(got[r["id"], c] for c in names) == pytest.approx(v[tuple(range(8))] - v[()], abs=1e-9)


def test_sampled_coalitions_keep_the_sum_rule_and_come_near(spark, fitted):
    model, df, names = fitted
    bg, rows = df.where("id >= 280"), df.where("id < 6")
    exact = {(r["id"], r["feature"]): r["phi"] for r in E.kernel_shapley(model, rows, bg, names).collect()}
    some = {(r["id"], r["feature"]): r["phi"] for r in E.kernel_shapley(model, rows, bg, names, n_coalitions=120).collect()}
    for i in range(6):
        assert sum(some[i, c] for c in names) == pytest.approx(sum(exact[i, c] for c in names), abs=1e-9)
    error = np.array([some[k] - exact[k] for k in exact])
    assert np.sqrt((error ** 2).mean()) < 0.2 * np.std(list(exact.values()))


def test_kernel_shapley_edge_cases(spark, fitted):
    model, df, names = fitted
    with pytest.raises(ValueError):
        E.kernel_shapley(model, df, df.where("false"), names)
    assert E.kernel_shapley(model, df.where("false"), df, names).count() == 0
    twice = df.where("id = 1").unionByName(df.where("id = 1"))
    assert E.kernel_shapley(model, twice, df, names, n_coalitions=40).count() == 16
    one = Pipeline(stages=[VectorAssembler(inputCols=["c0"], outputCol="f"), GBTRegressor(featuresCol="f", labelCol="y", maxIter=2, seed=1)]).fit(df)
    got = E.kernel_shapley(one, df.where("id < 3"), df, ["c0"], n_background=5).collect()
    assert len(got) == 3 and all(r["feature"] == "c0" for r in got)
    masks, weights = E.coalitions(2)
    assert sorted(map(tuple, masks.tolist())) == [(0.0, 1.0), (1.0, 0.0)] and np.allclose(weights, weights[0])


class _Recorder:
    """A model that predicts 1.0 and keeps what it was asked to score."""

    def __init__(self):
        self.asked = []

    def transform(self, df):
        self.asked.append(df)
        return df.withColumn("prediction", F.lit(1.0))


def test_hybrids_of_one_partition_are_scored_in_many(spark):
    names = [f"c{i}" for i in range(8)]
    df = spark.range(400).select("id", *[(F.col("id") * (i + 3) % 17).cast("double").alias(c) for i, c in enumerate(names)]).coalesce(1)
    model = _Recorder()
    phi = E.kernel_shapley(model, df, df, names)
    sizes = model.asked[-1].select("__rid").rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(sizes) == 400 * 254 * 20 and max(sizes) < 400_000
    plan = model.asked[-1]._jdf.queryExecution().executedPlan().toString()
    # the exploded rows are neither broadcast nor dealt by a coalition or a background row
    assert "BuildLeft" not in plan and "SortMergeJoin" not in plan and "hashpartitioning(__c" not in plan and "hashpartitioning(__b" not in plan
    assert phi.count() == 400 * 8


def test_histograms_of_one_bucket_need_no_join(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,), (4.0,)], "v double")
    for h, want in ((P.auto_histogram(df.where("v = 3 or v is null"), "v"), [2]), (P.histogram(df, "v", 1), [3]), (P.histogram(df, "v", 3), [2, 0, 1])):
        assert "Join" not in h._jdf.queryExecution().executedPlan().toString()
        assert [r["count"] for r in h.orderBy("bucket").collect()] == want
