import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from gradelens.llm import filter_audit, hidden_markov, token_align
from gradelens.llm import slices as slices_of_numbers
from llm.conftest import DOCS, ODD, long_text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("top", [0, 1, 65_535, 65_536, 1 << 23, 1 << 30])
def test_packed_numbers_come_back(top):
    values = np.random.default_rng(8).integers(0, top + 1, 1000)
    values[0] = top
    assert slices_of_numbers.unpacked(slices_of_numbers.packed(values)).tolist() == values.tolist()


# ---- hidden Markov model ------------------------------------------------------------------------------------------

def _parameters(classes, states, seed=1):
    rng = np.random.default_rng(seed)
    emit, move, begin = rng.random((classes, states)), rng.random((states, states)), rng.random(states)
    return begin / begin.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)


def test_forward_recursion_sums_over_all_paths():
    begin, move, emit = _parameters(5, 3)
    lengths = np.array([1, 4, 0, 6, 2])
    cls = np.random.default_rng(2).integers(0, 5, lengths.sum())
    got, at = hidden_markov.log_likelihood(cls, lengths, begin, move, emit), 0
    for n, value in zip(lengths, got):
        seq, at = cls[at:at + n], at + n
        whole = 0.0 if n else 1.0
        for path in itertools.product(range(3), repeat=int(n)) if n else ():
            p = begin[path[0]] * emit[seq[0], path[0]]
            for t in range(1, n):
                p *= move[path[t - 1], path[t]] * emit[seq[t], path[t]]
            whole += p
        assert value == pytest.approx(math.log10(whole), abs=1e-12)


def test_expected_counts_are_those_of_all_paths():
    begin, move, emit = _parameters(4, 2, seed=3)
    lengths = np.array([3, 5, 1])
    cls = np.random.default_rng(4).integers(0, 4, lengths.sum())
    emits, moves, begins, fit = hidden_markov.expected_counts(cls, lengths, begin, move, emit)
    want_e, want_m, want_b, logs, at = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2), 0.0, 0
    for n in lengths:
        seq, at = cls[at:at + n], at + n
        paths = list(itertools.product(range(2), repeat=int(n)))
        ps = np.array([begin[p[0]] * emit[seq[0], p[0]] * np.prod([move[p[t - 1], p[t]] * emit[seq[t], p[t]] for t in range(1, n)]) for p in paths])
        logs += math.log10(ps.sum())
        for p, w in zip(paths, ps / ps.sum()):
            want_b[p[0]] += w
            for t in range(n):
                want_e[seq[t], p[t]] += w
                if t:
                    want_m[p[t - 1], p[t]] += w
    for got, want in ((emits, want_e), (moves, want_m), (begins, want_b)):
        assert np.allclose(got, want, atol=1e-12)
    assert fit == pytest.approx(logs)


def test_scores_of_documents(spark, make):
    texts = [*ODD, *[f"the cat sat on the mat {i}" for i in range(30)], *[f"le chat dort sur Le lit {i}" for i in range(30)], "never seen words"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "THE CAT"), (None, "the cat")]
    docs = make(rows)
    slices = hidden_markov.slices_of(docs, slice_bytes=4000)
    counts = hidden_markov.word_counts(slices)
    model, fits = hidden_markov.fit(slices, counts, states=3, rounds=4)
    assert slices.count() > 2
    assert all(b >= a - 1 for a, b in zip(fits[1:], fits[2:]))           # but for the smoothing, no round makes the fit worse
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and model.begin.sum() == pytest.approx(1)
    got = hidden_markov.score(slices, counts, model).collect()

    def tokens(t):
        return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))] + [b""]

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held[i], len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want

    cls = {w: k for r in slices.select("word", "class").collect() for w, k in zip(map(bytes, r["word"]), r["class"])}
    assert set(c) <= set(cls) and counts.where("first AND count > 0").count() == len(c)
    for r in got:                                                         # the model's score by a plain recursion
        text = [t for i, t in rows if i == r.doc_id and len(tokens(t)) == r.n_tokens]
        if len(text) != 1 or not all(w in c for w in tokens(text[0])) or r.n_tokens > 300:
            continue
        alpha, total = None, 0.0
        for w in tokens(text[0]):
            k = cls[w]
            b = model.emit[k] * (c[w] + 1) / (model.class_tokens[k] + model.class_words[k] + 1)
            alpha = (model.begin if alpha is None else alpha @ model.move) * b
            total, alpha = total + math.log10(alpha.sum()), alpha / alpha.sum()
        assert r.score == pytest.approx(total, abs=1e-6)


def test_model_of_nothing(spark, make):
    assert hidden_markov.report(make([]).where("false"), states=2, rounds=2).collect() == []
    only_held = [(i, "a b") for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = hidden_markov.report(make(only_held), states=2, rounds=2).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(3, 0, 0, 0.0)] * 3


def test_held_out_documents_fit_better_than_by_word_counts(spark):
    from gradelens.sources.tables import read_table
    docs = read_table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text")
    r = hidden_markov.report(docs, rounds=3).groupBy("held_out").sum("score", "base_score").where("held_out").first()
    assert r["sum(score)"] > r["sum(base_score)"]


# ---- token alignment ----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    byte = token_align.byte_of_char()

    def of(text):
        t = text or ""
        ids, pieces = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ab = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids]
        bb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        return (ids, ab, pieces, bb) if t and b"".join(ab) == (" " + t).encode() == b"".join(bb) else ([], [], [], [])
    return of


def _aligned(ids, ab, pieces, bb):
    """Groups and links, token by token."""
    a_end, b_end = list(itertools.accumulate(map(len, ab))), list(itertools.accumulate(map(len, bb)))
    groups, i, j = [], 0, 0
    for cut in sorted(set(a_end) & set(b_end)):
        left, right = [], []
        while i < len(ids) and a_end[i] <= cut:
            left.append(str(ids[i]))
            i += 1
        while j < len(pieces) and b_end[j] <= cut:
            right.append(str(pieces[j]))
            j += 1
        groups.append(",".join(left) + "|" + ",".join(right))
    links = Counter((x, y) for x, xe, xl in zip(ids, a_end, ab) for y, ye, yl in zip(pieces, b_end, bb) if max(xe - len(xl), ye - len(yl)) < min(xe, ye))
    return groups, links


def test_alignment_against_brute_force(spark, make, libraries):
    marks = ["▁", "▁▁ a", "<|endoftext|>", "<s> </s>", "<0x0A>", "a\0b", "� x", "ﬁne ½ ①", "\r\n\r\n a  b\x1c", "it's 12,345.67 don't", "ünïcödé wörds naïve"]
    texts = [t if t is None or len(t) < 2500 else t[:2500] for t in ODD] + marks + [long_text(150, seed=i) for i in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "word"), (None, "the word")]
    got = token_align.report(make(rows), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN, slice_bytes=3000).collect()
    parts = [(i, libraries(t)) for i, t in rows]
    done = [(i, x, *_aligned(*x)) for i, x in parts]
    holds = Counter(p for *_, links in done for p in links)
    top = {}
    for (a, _), n in holds.items():
        top[a] = max(top.get(a, 0), n)
    want = sorted((str(i), len(x[0]), len(x[2]), len(groups), sum(links.values()), sum(n for p, n in links.items() if holds[p] == top[p[0]]),
                   sum(n * holds[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
                  for i, x, groups, links in done)
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want


def test_pieces_kept_are_the_library_s_ids(libraries):
    rng = np.random.default_rng(5)
    bits = [" ", "  ", "\n", "\n ", "\t", "a", "b'", "'s", "'ll", "9", "12", "é", "ß", "<|endoftext|>", ".", ",--", "The", "naïve"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 40))) for _ in range(2000)]
    encoder = token_align.ByteLevel(P.path("byte_bpe_50k.json"), P.PATTERN)
    plain = token_align.ByteLevel(P.path("byte_bpe_50k.json"), None)
    assert [x.tolist() for x in encoder.ids(texts)] == [x.tolist() for x in plain.ids(texts)]


def test_alignment_of_an_empty_table(spark, make):
    assert token_align.report(make([]).where("false"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN).collect() == []


# ---- filter audit -------------------------------------------------------------------------------------------------

def test_merges_are_set_operations():
    rng = np.random.default_rng(6)
    for _ in range(200):
        lists = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(5)]
        assert filter_audit.union(lists).tolist() == sorted(set().union(*map(set, lists)))
        assert filter_audit.gallop(lists[0], lists[1]).tolist() == [x in set(lists[1].tolist()) for x in lists[0].tolist()]


def _audit(rows, labels):
    text = {k: (t or "") for k, (_, t, _) in enumerate(rows)}
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[text[k]] = min(least.get(text[k], i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    out, by_part = [], {}
    for k, (i, _, s) in enumerate(rows):
        t, w = text[k], re.findall(r"[^\x20\x09-\x0D]+", text[k])
        fails = {f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                                               bool(re.search("[#$%&*|]", t)), i is not None and i > least[t])) if bad}
        by_part.setdefault(s or "", []).append((i, fails))
    for part, docs in by_part.items():
        rows_of, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                rows_of.append(["".join(order), step, len(left), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == {f} for d in docs),
                                sum(d[0] is not None and d[0] in good for d in gone), sum(d[0] is not None and d[0] in toxic for d in gone), f])
        out += [(part, *r[:-1], total[r[-1]]) for r in rows_of]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_brute_force(spark):
    words = long_text(200, seed=9).split()
    rng = np.random.default_rng(7)
    rows = []
    for k in range(300):
        t = " ".join(rng.choice(words, rng.integers(1, 120)))
        rows.append((int(rng.integers(0, 200)), rng.choice([t, t.upper(), t + " $", "same text", ""]), rng.choice(["a", "b", "c"])))
    rows += [(None, "same text", "a"), (None, None, None), (7, None, ""), (8, "x　y " * 80, "a"), *[(9, "again " * 60, "b")] * 5]
    labels = [(i, int(i % 2), int(i % 3 == 0)) for i in range(0, 150)] + [(3, 0, 1), (4, None, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS h", "'x' AS words", "2 AS salt", "true AS later_copy", "0 AS marks")
    got = filter_audit.audit(docs.repartition(5), spark.createDataFrame(labels, LABELS)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == _audit(rows, labels)


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(docs, spark.createDataFrame([], LABELS)).collect() == []
    one = spark.createDataFrame([(1, "a b", "en", None, 3)], DOCS)
    assert filter_audit.audit(one, spark.createDataFrame([], LABELS)).count() == 600
