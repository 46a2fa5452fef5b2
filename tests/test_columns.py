"""Column metadata operators."""
import pytest

from gradelens.operators.cohort import class_guard, non_empty_options
from gradelens.operators.columns import (align_features, column_mapping, columns_by_type, default_target,
                                         displayable_columns, drop_model_columns, identity_columns,
                                         missing_features, new_columns, override_mapping)


def test_override_mapping():
    cols = ["Gaming_Hours", "Sleep_Time", "Other"]
    auto = column_mapping(cols)
    m = override_mapping(auto, {"sommeil": "Other", "jeux_video": None}, cols)
    assert m["sommeil"] == "Other" and "jeux_video" not in m
    with pytest.raises(ValueError):
        override_mapping(auto, {"sommeil": "nope"}, cols)
    with pytest.raises(ValueError):
        override_mapping(auto, {"unknown": "Other"}, cols)


def test_drop_align_and_lists(spark):
    df = spark.createDataFrame([(1, "A", 12.0, 1, 3.0, "22:00", "x")],
                               "id long, nom string, note_maths double, reussite int, h double, "
                               "heure_coucher string, mail string")
    assert drop_model_columns(df).columns == ["id", "h", "mail"]
    assert drop_model_columns(df, uploaded=True).columns == ["note_maths", "h", "heure_coucher"]
    aligned = align_features(df, ["h", "missing_col"], keep=["id"])
    assert aligned.columns == ["id", "h", "missing_col"] and aligned.first()["missing_col"] == 0
    assert missing_features(["h", "zz"], df) == ["zz"]
    assert new_columns(["a"], ["a", "b"]) == ["b"]
    num, txt = columns_by_type(df)
    assert "h" in num and "nom" in txt
    assert identity_columns(df, "note_maths") == ["id", "nom", "mail", "note_maths"]
    assert displayable_columns(df) == ["note_maths", "reussite", "h", "heure_coucher"]
    assert default_target(df) == ("id", 10.0)


def test_class_guard_and_options(spark):
    assert class_guard(spark.createDataFrame([(0,), (1,)], "y int"), "y")
    assert not class_guard(spark.createDataFrame([(1,), (1,)], "y int"), "y")
    df = spark.createDataFrame([("a",), ("",), (None,), ("a",)], "c string")
    assert [r[0] for r in non_empty_options(df, "c").collect()] == ["a"]
    empty = spark.createDataFrame([("",), (None,)], "c string")
    assert [r[0] for r in non_empty_options(empty, "c").collect()] == ["Inconnu"]


def test_numeric_defaults(spark):
    from gradelens.ml.scoring import numeric_defaults
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, None)], "x double, t string")
    rows = {(r["feature"], r["option"]): r["default_value"] for r in numeric_defaults(df, ["x", "t"]).collect()}
    assert rows == {("x", None): 2.0, ("t", "a"): None, ("t", "b"): None}


def test_scale_conf_sizes_partitions(spark):
    from gradelens.session import MB, apply_scale_conf, scale_conf
    big = scale_conf(100 * (1 << 40), 8000)
    assert big["spark.sql.shuffle.partitions"] == "100000"
    assert scale_conf(10 * MB, 8)["spark.sql.shuffle.partitions"] == "16"
    conf = apply_scale_conf(spark, ["/root/testdata/sf0.001/orders.parquet"], 4)
    assert spark.conf.get("spark.sql.shuffle.partitions") == conf["spark.sql.shuffle.partitions"] == "8"
    spark.conf.set("spark.sql.shuffle.partitions", "8")
