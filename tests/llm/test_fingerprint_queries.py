import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from gradelens.llm import fingerprint, fingerprint as fp
from gradelens.llm.queries import ORACLES, QUERIES
from gradelens.sources.tables import TABLES
from llm.conftest import ODD, long_text

SF = "/root/testdata/sf0.001"


def _prose(n, seed):
    w = long_text(n, seed).split()
    return "".join(x + (".\n" if i % 23 == 22 else ". " if i % 7 == 6 else " ") for i, x in enumerate(w))


def test_equal_texts_have_equal_trees_and_edits_are_located():
    a = _prose(400, 1)
    assert fp.tree(a) == fp.tree(a) and fp.likeness(fp.tree(a), fp.tree(a)) == 1.0 and fp.edits(fp.tree(a), fp.tree(a)) == []
    lines = a.split("\n")
    lines[5] = "Something else stands here now."
    b = "\n".join(lines)
    assert fp.edits(fp.tree(a), fp.tree(b)) == [5] and 0.8 < fp.likeness(fp.tree(a), fp.tree(b)) < 1
    assert fp.likeness(fp.tree(a), fp.tree(_prose(400, 2))) < 0.05
    assert fp.tree(None) == fp.tree("") and fp.likeness(fp.tree(""), fp.tree("x")) < 1
    assert fp.tree("a\nb") != fp.tree("ab") and fp.tree("a. b") != fp.tree("a.\nb")


def _brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + n[:half]
        a = fp.tree(t)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, fp.tree(e), fp.likeness(a, fp.tree(e)), fp.likeness(a, fp.tree(n))))
    return sorted(out)


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: (i * 7919) % 1009 - 300])
def test_edited_texts_equal_brute_force(make, ids):
    rows = [(ids(i), t) for i, t in enumerate(ODD + [_prose(30 + i, i) for i in range(80)])]
    assert sorted(tuple(r) for r in fp.edit_report(make(rows).repartition(5)).collect()) == _brute(rows)


def test_lone_repeated_and_null_rows(make):
    (r,) = fp.edit_report(make([(3, "abcd")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1.0
    assert fp.edit_report(make([])).count() == 0
    rows = fp.edit_report(make([(1, "same"), (1, "same"), (None, "x"), (2, "y")])).collect()
    assert len(rows) == 4 and len({r["fingerprint"] for r in rows if r["doc_id"] == 1}) == 1
    got = fp.fingerprints(make(["a", "a", None]).withColumn("root", F.lit(1))).collect()
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[2]["fingerprint"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name,table,columns", [
    ("op1_packing", "documents", {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}),
    ("op2_url_filter", "pages", {"page_id", "host", "path", "rule", "verdict"}),
    ("op4_language", "documents", {"doc_id", "held_out", "lang_pred", "score"}),
    ("op5_toxicity", "documents", {"doc_id", "held_out", "score", "predicted"}),
    ("op7_pii", "documents", {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}),
    ("op8_token_counts", "documents", {"doc_id", "n_bytes", "n_tokens", "over_limit"}),
    ("op10_fingerprints", "documents", {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}),
])
def test_query_covers_its_whole_table(spark, name, table, columns):
    rows = E.queries()[name](spark, SF)
    key = "page_id" if table == "pages" else "doc_id"
    ids = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    assert columns <= set(rows.columns)
    assert rows.select(key).distinct().count() == ids.count() and (name == "op1_packing" or rows.count() == ids.count())


def test_language_is_right_on_held_out_documents(spark):
    got = {r["doc_id"]: r for r in QUERIES["op4_language"](spark, SF).collect()}
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs) / len(docs) >= 0.9


def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "decontamination", "personal_data", "packing"]
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, held, SF).collect(), docs.schema)
        assert out.columns == docs.columns and 0 < out.count() <= held.count()
        if name == "near_copies":
            assert out.count() == _n_classes(held)
        if name == "personal_data":
            assert out.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]")).count() == 0
        held = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, held, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in held.select("doc_id").collect()}
    final = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sum(r["length"] for r in final) == sum(r["length"] for r in pieces) and len({key(r)[0] for r in final}) == len({key(r)[0] for r in pieces})


def _n_classes(docs):
    from gradelens.llm.near_dup import classes
    return classes(docs).select("component_id").distinct().count()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_stand_odd_and_no_rows(spark, make, k):
    stage = corpus_pipeline.STAGES[k][1]
    docs = make(ODD + [(None, "null id"), (0, None)])
    out = stage(spark, docs, SF)
    assert k == 4 or out.columns == docs.columns
    assert out.count() > 0 and stage(spark, make([]), SF).count() == 0


def test_rows_of_one_id_are_split_and_keep_their_order(make, spark):
    rows = [(7, f"seven {i}") for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(7, "seven 1")] * 3 + [(9, "nine"), (-(1 << 63), "least"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprint.with_next(docs, lambda d, a, b: (d, a, b), "doc_id long, a string, b string")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    order = [(r[0], r[1] or "") for r in docs.orderBy(F.desc(F.coalesce("doc_id", F.lit(-(1 << 63)))), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    want = [(d, a, order[(i + 1) % len(order)][1]) for i, (d, a) in enumerate(order)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert max(sizes) <= len(rows) / 2
    assert fingerprint.with_next(docs.where("false"), lambda d, a, b: (d, a, b), "doc_id long, a string, b string").count() == 0
