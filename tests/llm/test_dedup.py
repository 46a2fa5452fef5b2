import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelens.llm import near_dup, substrings
from gradelens.llm.components import components
from llm.conftest import ODD, long_text


def _brute_classes(texts, percent=80):
    sets = []
    for t in texts:
        w = ((t or "").encode().lower()).split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def _variants(n, base, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_classes_equal_brute_force(make, percent):
    base = long_text(150, 5)
    texts = ODD + _variants(120, base, 1) + [base] * 5 + [long_text(60, i) for i in range(30)] + [base.upper(), " ".join(base.split()[:4])]
    random.Random(0).shuffle(texts)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.classes(make(texts), percent).collect())
    assert got == _brute_classes(texts, percent)
    assert near_dup.classes(make([])).count() == 0 and near_dup.least_matches(85) == 92


def test_blocks_lose_no_link(make, monkeypatch):
    monkeypatch.setattr(near_dup, "LIST_BLOCK", 8)
    monkeypatch.setattr(near_dup, "FAMILY_BLOCK", 8)
    texts = _variants(90, long_text(120, 9), 2)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.classes(make(texts)).collect())
    assert got == _brute_classes(texts)


def test_signatures_that_match_share_a_prefix():
    rng = np.random.default_rng(3)
    for matches in (84, 92, 128):
        for _ in range(200):
            a = rng.integers(0, 2**32, near_dup.COORDS, dtype=np.uint32)
            b = a.copy()
            off = rng.permutation(near_dup.COORDS)[matches:]
            b[off] = rng.integers(0, 2**32, len(off), dtype=np.uint32)
            counts = rng.choice(np.array([0, 1, 5, 2**32 - 1], np.uint32), near_dup.SLOTS)      # any counts, many ties
            x, y = (near_dup.prefixes(t[None, :], counts, matches)[0] for t in (a, b))
            assert len(x) == near_dup.COORDS - matches + 1 and set(x.tolist()) & set(y.tolist())


def test_a_common_passage_stays_out_of_the_prefixes(make, spark):
    passage = long_text(80, 1)
    docs = make([f"{long_text(80, 100 + i)} {passage}" for i in range(200)])
    texts = near_dup._signed(docs.select("doc_id", "text", F.lit(0).cast("long").alias("rk")).withColumn("text", F.col("text").cast("binary")), 5)
    lists = near_dup._posted(texts, 92).groupBy("key").count()
    assert lists.agg(F.sum("count")).first()[0] == 200 * 37 and lists.agg(F.max("count")).first()[0] < 100
    sig = near_dup._unpacked(texts.select("sig").toArrow().column("sig").combine_chunks())
    assert max(np.unique(sig[:, c], return_counts=True)[1].max() for c in range(near_dup.COORDS)) > 150


def _at_similarity(rng, percent, size=200):
    """Two texts of ``size`` words whose shingle sets have at least, and nearly, that similarity."""
    a = [f"w{rng.randrange(10**9)}" for _ in range(size)]
    tail = 1                                            # words of the end that differ: shingles lost are as many
    while 100 * (size - 4 - tail - 1) >= percent * (size - 4 + tail + 1):
        tail += 1
    return " ".join(a), " ".join(a[:-tail] + [f"z{rng.randrange(10**9)}" for _ in range(tail)])


def test_recall_by_similarity(make):
    rng = random.Random(11)
    texts, bands = [], []
    for percent in (85, 87, 90, 95):
        for _ in range(120):
            texts += _at_similarity(rng, percent)
            bands.append(percent)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.classes(make(texts), 85).collect()}
    missed = [band for i, band in enumerate(bands) if got[2 * i + 1] != 2 * i]
    assert not missed and all(got[2 * i] == 2 * i for i in range(len(bands)))


def test_hot_template_in_parts(make, monkeypatch):
    """Two templates' variants, and chains of texts each like the one before: lists and families of many blocks."""
    monkeypatch.setattr(near_dup, "LIST_BLOCK", 16)
    monkeypatch.setattr(near_dup, "FAMILY_BLOCK", 16)
    words = long_text(400, 3).split()
    chain = [" ".join(words[4 * i:4 * i + 100]) for i in range(70)]
    texts = _variants(150, long_text(100, 4), 5) + _variants(150, long_text(100, 6), 7) + chain
    random.Random(1).shuffle(texts)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.classes(make(texts)).collect())
    assert got == _brute_classes(texts)


def test_deduplicate_keeps_one_of_each_class_with_its_columns(make, spark):
    a, b = long_text(100, 1), long_text(100, 2)
    docs = make([(5, a), (3, a + " more"), (3, a + " more"), (9, b), (None, b), (7, None), (8, ""), (8, "")]).withColumn("root", F.lit("x"))
    got = sorted((r["doc_id"], r["root"]) for r in near_dup.deduplicate(docs).collect())
    assert got == [(3, "x"), (7, "x"), (8, "x"), (9, "x")]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_intersections_of_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (1, 50, 200, 120, 120)]
    got = near_dup.shared(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(5) for j in range(5))


def _brute_removal(rows, window=20):
    """``rows``: (doc_id, text); what is left of each, judged on the input."""
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (d, i):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_removal_equals_brute_force(make):
    rng = random.Random(8)
    passages = [long_text(n, n) for n in (20, 21, 35, 60, 200)]
    texts = list(ODD)
    for i in range(60):
        parts = [long_text(rng.randint(0, 30), 1000 + i)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            a = rng.randrange(len(p))
            parts += [" ".join(p[a:a + rng.randint(15, 80)]), long_text(rng.randint(0, 12), rng.randrange(50))]
        texts.append("\n".join(parts))
    texts += [texts[12]] * 3 + ["a b " * 60, "a " * 100, passages[4] + " " + passages[4]]
    got = sorted(tuple(r) for r in substrings.deduplicate(make(texts)).collect())
    assert got == _brute_removal(list(enumerate(texts)))
    assert substrings.deduplicate(make([])).count() == 0


def test_repeated_rows_and_null_ids(make):
    p = long_text(40, 3)
    got = substrings.deduplicate(make([(4, p), (4, p), (None, p), (9, p)])).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else 99, r["n_removed"]) for r in got) == [(4, 0), (4, 0), (9, 40), (99, 40)]


@pytest.mark.parametrize("text", [" ".join(["w"] * 50), " ".join("ab" * 40)])
def test_repeats_inside_one_document(make, text):
    got = [tuple(r) for r in substrings.deduplicate(make([text])).collect()]
    assert got == _brute_removal([(0, text)])


def test_texts_of_one_id_with_equal_short_hashes_stay_apart(make, spark):
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * 41 + j).cast("string")) for j in range(30)])
    hashed = spark.range(300_000).select(text.alias("text"), F.hash(text).alias("h"))
    a, b = hashed.groupBy("h").agg(F.sort_array(F.collect_list("text")).alias("t")).where(F.size("t") == 2).orderBy("h").first()["t"]
    assert a != b
    assert sorted(r["text"] for r in near_dup.deduplicate(make([(None, a), (None, b)])).collect()) == [a, b]
    begin = " ".join(a.split()[:25])
    got = substrings.deduplicate(make([(1, begin), (None, a), (None, b)]), with_text=True).collect()
    assert sorted((r["n_removed"], r["text"]) for r in got) == sorted([(0, begin), (25, " ".join(a.split()[25:])), (0, b)])


def test_thinned_edges_connect_the_same_nodes(spark):
    from gradelens.llm.components import components, thinned
    rng = random.Random(5)
    forests = [(min(g), x) for g in ([rng.randrange(k * 100, k * 100 + 100) for _ in range(30)] for k in range(4) for _ in range(40)) for x in g]
    edges = spark.createDataFrame(forests + [(b, a) for a, b in forests[:50]], "a long, b long")
    root = {x: x for e in forests for x in e}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in forests:
        x, y = sorted((up(a), up(b)))
        root[y] = x
    linked = {x for a, b in forests if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {x: up(x) for x in linked}
    assert thinned(edges).count() < edges.distinct().count() / 2
    assert components(edges.where("a = b")).count() == 0
