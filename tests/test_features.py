"""Column mapping and derived features (the reference's feature tests)."""
import pytest
from pyspark.sql import functions as F

from gradelens.operators.columns import column_mapping, lower_names, require_columns
from gradelens.operators.features import add_clock_features, add_features
from gradelens.plans.prepare import prepared_cohort

from conftest import SF_SMOKE

RENAMED = ["Nom_Eleve", "Temps_Sommeil", "Gaming_Hours", "Study_Time", "Sport_User", "Moyenne_Generale", "Bedtime"]


def test_mapping_of_renamed_columns():
    m = column_mapping(RENAMED)
    assert m == {"sport": "Sport_User", "jeux_video": "Gaming_Hours", "sommeil": "Temps_Sommeil",
                 "etude": "Study_Time", "note_moyenne": "Moyenne_Generale", "heure_coucher": "Bedtime"}


def test_features_on_renamed_rows(spark):
    rows = [("Alice", 8.0, 1.0, 2.0, "oui", 15.5, "22h30"), ("Bob", 6.0, 4.0, 1.0, "non", 9.5, "23:45")]
    df = spark.createDataFrame(rows, RENAMED)
    out = add_features(add_clock_features(df)).orderBy("Nom_Eleve").collect()
    a, b = out
    assert a["temps_ecrans_total"] == 1.0 and b["temps_ecrans_total"] == 4.0
    assert a["score_equilibre"] == pytest.approx(2.5) and b["score_equilibre"] == pytest.approx(1.0)
    assert a["ratio_etude_ecrans"] == pytest.approx(4 / 3) and b["ratio_etude_ecrans"] == pytest.approx(2 / 9)
    assert (a["stress_total"], a["indice_motivation"]) == (0, 5.0)
    assert [a["reussite"], b["reussite"]] == [1, 0]
    assert [a["Bedtime_num"], b["Bedtime_num"]] == [22.5, 23.75]


def test_double_counting_of_video_keyword(spark):
    df = spark.createDataFrame([(3.0,)], "heures_jeux_video double")
    assert add_features(df).first()["temps_ecrans_total"] == 6.0


def test_prepared_cohort_properties(spark):
    df = prepared_cohort(spark, SF_SMOKE)
    for c in ["score_equilibre", "stress_total", "reussite", "indice_motivation", "heure_lever_num"]:
        assert c in df.columns
    labels = {r[0] for r in df.select("reussite").distinct().collect()}
    assert labels <= {0, 1}
    assert df.where(F.col("score_equilibre") < 0).count() == 0


def test_input_unchanged(spark):
    df = spark.createDataFrame([(8.0, 1.0)], "heures_sommeil double, heures_jeux_video double")
    before = list(df.columns)
    add_features(df)
    assert df.columns == before


def test_require_and_lower(spark):
    df = spark.createDataFrame([(1, 2)], "A int, b int")
    assert lower_names(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        require_columns(df, ["A", "zz"])
    with pytest.raises(ValueError):
        lower_names(spark.createDataFrame([(1, 2)], "A int, a int"))
