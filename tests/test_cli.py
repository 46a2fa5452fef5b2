"""End to end on an uploaded CSV without an id column, and the report."""
import glob

import pytest
from pyspark.sql import functions as F

from gradelens.functions import constants as K
from gradelens.plans.cli import load_csv, run
from gradelens.plans.prepare import raw_cohort
from gradelens.plans.report import build_report, write_report
from gradelens.sources.csv_io import write_table_csv

from conftest import SF_SMOKE


@pytest.fixture(scope="module")
def csv(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("upload") / "table")
    write_table_csv(raw_cohort(spark, SF_SMOKE).drop("id").withColumnRenamed("heures_sommeil", "Nuit"), path)
    return path


def test_upload_gets_ids_and_a_target(spark, csv):
    df, target = load_csv(spark, csv)
    assert target == "note_moyenne" and df.select("id").distinct().count() == df.count() == 150
    assert load_csv(spark, csv, "note_maths")[1] == "note_maths"
    with pytest.raises(ValueError):
        load_csv(spark, csv, "absent")


def test_run_on_an_upload(spark, csv, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "GBT_GRID", {"maxIter": [3], "maxDepth": [2], "stepSize": [0.1]})
    monkeypatch.setattr(K, "RF_GRID", {"numTrees": [5], "maxDepth": [3], "minSamplesSplit": [2]})
    out = str(tmp_path)
    text = run(spark, out, csv=csv, threshold=9.0, mapping={"sommeil": "nuit"}, families=["gbt_reg", "rf_clf"], folds=2)
    assert text.startswith("# Student performance report") and ">= 9.0" in text and "flagged" in text
    lines = open(glob.glob(f"{out}/predictions/part-*")[0], encoding="utf-8-sig").read().splitlines()
    assert "Note Prédite (Moy)" in lines[0] and "Prédit_maths" in lines[0] and ";" in lines[0]
    for name in ("impact", "failure_impact"):
        assert {"feature", "mean_abs_impact"} <= set(spark.read.parquet(f"{out}/{name}").columns)
    assert spark.read.parquet(f"{out}/impact").where(F.col("feature") == "nuit").count() == 1


def test_report_file(spark, tmp_path):
    raw = raw_cohort(spark, SF_SMOKE)
    text = build_report(raw, [], impact=[("b", 0.5), ("a", 1.0)], n_at_risk=3)
    assert "1. a: 1.000" in text and "3 students are flagged" in text and "Lowest subject mean" in text
    assert write_report(spark, text, str(tmp_path / "r")) == text
    assert open(glob.glob(f"{tmp_path}/r/part-*")[0]).read().rstrip() == text.rstrip()
