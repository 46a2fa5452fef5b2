"""Streaming scoring and the CSV source/sink."""
import pytest
from pyspark.sql import functions as F

from gradelens.operators.clean import fit_clean
from gradelens.plans.prepare import raw_cohort
from gradelens.plans.training import excluded_columns, model_frame
from gradelens.operators.features import add_clock_features, add_features
from gradelens.ml.search import train_family
from gradelens.sources.csv_io import detect_separator, quotes_span_lines, read_table_csv, write_table_csv
from gradelens.streaming.scoring import read_rows, score_rows, start

from conftest import SF_SMOKE


def test_stream_scoring_matches_batch(spark, tmp_path):
    raw = raw_cohort(spark, SF_SMOKE)
    cleaner = fit_clean(raw, only_missing=False)
    prepared = model_frame(add_features(add_clock_features(cleaner.transform(raw))))
    excl = [c for c in excluded_columns(prepared) if c != "note_moyenne"]
    res = train_family(prepared.where("not is_test"), "note_moyenne", "mlp_reg", excl, n=1, steps=5)
    src = str(tmp_path / "incoming")
    raw.write.parquet(src)
    q = start(score_rows(read_rows(spark, src, raw.schema), cleaner, res.model), "scored_rows", fmt="memory")
    q.processAllAvailable()
    q.stop()
    streamed = {r["id"]: r["note_predite"] for r in spark.sql("SELECT id, note_predite FROM scored_rows").collect()}
    batch = {r["id"]: r["note_predite"] for r in score_rows(raw, cleaner, res.model).collect()}
    assert streamed.keys() == batch.keys()
    assert all(abs(streamed[k] - batch[k]) < 1e-9 for k in batch)


def test_csv_round_trip_and_tokens(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("﻿Nom;Age;Note;Flag;Txt\nA;12;10.5;True;NA\nB;NA;;False;x\n", encoding="utf-8")
    df = read_table_csv(spark, str(p))
    assert df.columns == ["nom", "age", "note", "flag", "txt"]
    assert dict(df.dtypes) == {"nom": "string", "age": "bigint", "note": "double", "flag": "boolean", "txt": "string"}
    rows = df.orderBy("nom").collect()
    assert rows[1]["age"] is None and rows[1]["note"] is None and rows[0]["txt"] is None
    out = str(tmp_path / "out")
    write_table_csv(df, out)
    back = read_table_csv(spark, out)
    assert back.orderBy("nom").collect() == rows
    assert detect_separator("a,b,c") == "," and detect_separator("a\tb") == "\t"
    assert read_table_csv(spark, str(tmp_path / "missing.csv")) is None


@pytest.mark.parametrize("text,sep", [
    ("nom;note\n\"a,b,c\";12,5\nd;3,5", ";"),                         # decimal commas, quoted commas
    ('"a;b;c;d","e"\n"1;2","3"\nx,y', ","),                           # quoted marks of another kind in the header
    ("nom, first;age\nx;1\ny, z;2", ";"),                             # an unquoted mark in one name only
    ('a|b\n"1\n2|3"|4\n5|6', "|"),                                    # a quoted line break
    ("a\tb,c\n1\t2\n3\t4,5", "\t"),
    ("a;b,c\n1;2,3\n4;5,6", ";"),                                     # tie
    ("one", ","), ("one\n1;2", ","), ("", ","),
])
def test_separator_is_the_one_of_constant_field_counts(text, sep):
    assert detect_separator(text) == sep


def test_quoted_separators_and_line_breaks(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('\ufeffNom,"Avis;note;x;y;z",Note\n"Lee, A","said ""no""\nand left; twice",12\nB,"1;2;3",\n"C","",7\n', encoding="utf-8")
    df = read_table_csv(spark, str(p))
    assert df.columns == ["nom", "avis;note;x;y;z", "note"]
    rows = sorted(map(tuple, df.collect()))
    assert rows == [("B", "1;2;3", None), ("C", None, 7), ("Lee, A", 'said "no"\nand left; twice', 12)]
    out = str(tmp_path / "out")
    write_table_csv(df, out)
    assert sorted(map(tuple, read_table_csv(spark, out).collect())) == rows


def test_line_break_far_behind_the_sniffed_lines(spark, tmp_path):
    p = tmp_path / "long.csv"
    p.write_text("a;b\n" + "".join(f"{i};x{i}\n" for i in range(1000)) + '1000;"y\nz"\n', encoding="utf-8")
    got = {r["a"]: r["b"] for r in read_table_csv(spark, str(p)).collect()}
    assert len(got) == 1001 and got[1000] == "y\nz" and got[7] == "x7"
    assert quotes_span_lines(spark.read.text(str(p)))
    p.write_text('a;b\n"1;2";3\n', encoding="utf-8")
    assert not quotes_span_lines(spark.read.text(str(p)))
