"""Cleaning and exact distributed quantiles."""
import numpy as np
import pytest

from gradelens.operators.clean import clean, column_modes, exact_medians, exact_quantiles


def test_imputation_golden(spark):
    df = spark.createDataFrame([(1.0, "b", None), (2.0, "a", None), (None, "b", None), (10.0, "a", None),
                                (3.0, None, None)], "x double, t string, empty double")
    out = clean(df)
    assert "empty" not in out.columns
    vals = out.collect()
    assert vals[2]["x"] == 2.5
    assert vals[4]["t"] == "a"


def test_clean_leaves_no_nulls_and_keeps_shape(spark):
    rows = [(float(i) if i > 5 else None, ("c%d" % (i % 3)) if not 3 <= i <= 7 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "h double, classe string")
    out = clean(df)
    assert out.count() == 50 and out.columns == ["h", "classe"]
    assert out.where("h is null or classe is null").count() == 0
    assert clean(None) is None


def test_integer_column_with_null_becomes_double(spark):
    df = spark.createDataFrame([(1,), (None,), (4,)], "k int")
    out = clean(df)
    assert dict(out.dtypes)["k"] == "double" and out.collect()[1]["k"] == 2.5


@pytest.mark.parametrize("cap", [10_000, 7])
def test_exact_quantiles_match_numpy(spark, cap):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(size=400), np.full(200, 0.25), rng.integers(0, 5, 200).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(5)
    got = exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.75, 1.0], collect_cap=cap, accuracy=100)["v"]
    assert got == pytest.approx(list(np.quantile(vals, [0.0, 0.25, 0.5, 0.75, 1.0])), abs=1e-12)


def test_median_even_and_hot_value(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert exact_medians(df, ["v"]) == {"v": 2.5}
    hot = spark.createDataFrame([(5.0,)] * 300 + [(float(i),) for i in range(600)], "v double")
    assert exact_medians(hot, ["v"], collect_cap=5, accuracy=50)["v"] == float(np.median([5.0] * 300 + list(range(600))))


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "t string")
    assert column_modes(df, ["t"]) == {"t": "a"}
