"""Scalar expressions against hand-derived golden rows (FIXTURES.md §2)."""
import pytest
from pyspark.sql import functions as F

from gradelens.functions import expr as X


def one(spark, col, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col.alias("o")).collect()]


CLOCKS = [("22h30", 22.5), ("6h00", 6.0), ("8h15", 8.25), ("invalide", 0.0), (None, 0.0), ("7.5", 7.5),
          ("22h", 22.0), ("22:30:15", 22.5), ("23:45", 23.75), (":30", 0.0), ("", 0.0), ("-1:30", -0.5)]


def test_parse_clock_golden(spark):
    got = one(spark, X.parse_clock(F.col("v")), [(v,) for v, _ in CLOCKS])
    assert got == pytest.approx([h for _, h in CLOCKS])


def test_truthy(spark):
    vals = ["oui", "Yes", "1", "True", "non", " oui ", "1.0", None]
    assert one(spark, X.truthy(F.col("v")), [(v,) for v in vals]) == [1, 1, 1, 1, 0, 0, 0, 0]


def test_pass_label_threshold(spark):
    got = one(spark, X.pass_label(F.col("v")), [(10.0,), (9.999,), (None,)], "v double")
    assert got == [1, 0, 0]


def test_to_number_guards_text(spark):
    got = one(spark, X.to_number(F.col("v")), [("3",), ("3d",), ("n/d",), (" 2.5 ",), ("1e2",)])
    assert got == [3.0, None, None, 2.5, 100.0]


def test_row_mean_and_sum(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(X.row_mean(["a", "b", "c"])).collect()] == [2.0, None]
    assert [r[0] for r in df.select(X.row_sum(["a", "b", "c", "a"])).collect()] == [5.0, 0.0]


def test_weighted_score_golden(spark):
    from gradelens.operators.scores import linear_grade
    row = dict(heures_etude_soir=2.0, interet_maths=5, interet_francais=5, heures_jeux_video=1.0,
               heures_reseaux_sociaux=1.0, stress_personnel=2, heures_sommeil=8.0, organisation=5,
               perseverance=3, activite_sportive="oui", duree_trajet_ar_min=30)
    df = spark.createDataFrame([row])
    assert df.select(linear_grade(df, 11.0)).first()[0] == pytest.approx(12.8)


def test_clip_keeps_null(spark):
    got = one(spark, X.clip(F.col("v")), [(25.0,), (-1.0,), (None,)], "v double")
    assert got == [20.0, 0.0, None]


def test_band_subject_label_format(spark):
    assert one(spark, X.band(F.col("v")), [(15.0,), (10.0,), (9.9,)], "v double") == ["green", "orange", "red"]
    assert one(spark, X.subject_label(F.col("v")), [("note_histoire_geo",)]) == ["Histoire_geo"]
    assert X.subject_label_text("note_histoire_geo") == "Histoire_geo"
    df = spark.createDataFrame([(7, 5)], "h int, m int")
    assert df.select(X.format_clock(F.col("h"), F.col("m"))).first()[0] == "07:05"


def test_recode_and_translate(spark):
    assert one(spark, X.recode(F.col("v")), [("Terminale",), ("1ere",)]) == ["terminale", "1ere"]
    assert one(spark, X.translate_name(F.col("v")), [("stress_total",), ("x",)]) == ["Stress Total", "x"]


def test_percent_and_at_risk(spark):
    df = spark.createDataFrame([(3, 4), (0, 0)], "p long, t long")
    assert [r[0] for r in df.select(X.percent(F.col("p"), F.col("t"))).collect()] == [75.0, 0.0]
    df = spark.createDataFrame([(50.0, 12.0), (70.0, 9.0), (70.0, 12.0)], "p double, n double")
    assert [r[0] for r in df.select(X.at_risk("p", "n")).collect()] == [True, True, False]
