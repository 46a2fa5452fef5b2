"""Profiling, metrics, split and lookup properties."""
import pytest
from pyspark.sql import functions as F

from gradelens.operators import metrics as M
from gradelens.operators import profile as P
from gradelens.operators.lookup import lookup
from gradelens.operators.sampling import train_test_split, with_folds, with_split
from gradelens.operators.scores import population_scale

from conftest import SF_SMOKE


def test_histogram_counts_sum_to_non_null(spark):
    df = spark.read.parquet(f"{SF_SMOKE}/orders.parquet")
    h = P.histogram(df, "o_totalprice", 25)
    assert h.count() == 25
    assert h.agg(F.sum("count")).first()[0] == df.where("o_totalprice is not null").count()


def test_profile_kinds_and_counts(spark):
    df = spark.createDataFrame([(i, f"c{i % 3}", float(i), f"{i % 24}:00") for i in range(40)],
                               "id long, classe string, x double, heure_coucher string")
    kinds = P.profile_kinds(df)
    assert kinds == {"classe": "counts", "x": "histogram", "heure_coucher": "clock"}
    prof = P.profile(df)
    assert prof.where("column = 'x'").agg(F.sum("count")).first()[0] == 40


def test_confusion_and_metrics_golden(spark):
    df = spark.createDataFrame(list(zip([1, 1, 0, 0, 1], [1, 0, 0, 1, 1])), "y int, p int")
    cm = {(r["actual"], r["predicted"]): r["count"] for r in M.confusion_matrix(df, "y", "p").collect()}
    assert cm == {(1, 1): 2, (0, 1): 1, (1, 0): 1, (0, 0): 1} and sum(cm.values()) == 5
    m = M.classification_metrics(df, "y", "p").first()
    assert m["accuracy"] == pytest.approx(60.0)
    assert (m["precision"], m["recall"], m["f1"]) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    none = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    m0 = M.classification_metrics(none, "y", "p").first()
    assert (m0["precision"], m0["recall"], m0["f1"]) == (0.0, 0.0, 0.0)
    reg = spark.createDataFrame([(3.0, 2.0), (5.0, 5.0), (7.0, 9.0)], "y double, p double")
    r = M.regression_metrics(reg, "y", "p").first()
    assert (r["mae"], r["rmse"], r["r2"]) == pytest.approx((1.0, 1.290994, 0.375), abs=1e-6)


def test_population_scaling_golden(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0)], "a double, k double")
    out = population_scale(df, ["a", "k"]).collect()
    assert [r["a"] for r in out] == pytest.approx([-1.069045, -0.267261, 1.336306], abs=1e-6)
    assert [r["k"] for r in out] == [0.0, 0.0, 0.0]


def test_split_is_a_partition_and_partitioning_free(spark):
    df = spark.read.parquet(f"{SF_SMOKE}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    tr, te = train_test_split(df)
    n = df.count()
    assert tr.count() + te.count() == n and tr.join(te, "id").count() == 0
    a = {r[0] for r in with_split(df).where("is_test").select("id").collect()}
    b = {r[0] for r in with_split(df.repartition(7)).where("is_test").select("id").collect()}
    assert a == b and 0.1 < len(a) / n < 0.3
    folds = {r[0] for r in with_folds(df).select("fold").distinct().collect()}
    assert folds == {0, 1, 2}


def test_class_balance_and_best(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    w = {r["label"]: r["weight"] for r in M.class_balance(df, "y").collect()}
    assert w == pytest.approx({0: 4 / 6, 1: 2.0})
    scores = spark.createDataFrame([("r", "gbt", 0.5, 0), ("r", "mlp", 0.5, 1), ("r", "svm", 0.4, 2)],
                                   "task string, family string, score double, priority int")
    assert M.select_best(scores).first()["family"] == "gbt"


def test_lookup_keeps_unmatched(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    table = spark.createDataFrame([("a", "A")], "key string, val string")
    assert [r[0] for r in lookup(df, "k", table, "key", "val").orderBy("k").collect()] == ["A", "z"]
