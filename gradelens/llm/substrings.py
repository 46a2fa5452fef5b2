"""Removal of passages that occur earlier in the corpus, with repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document; a word goes when a
window over it has an earlier occurrence (smaller document, or the same document
and an earlier start).  Every window is decided exactly:

1. Of all phrases (``PHRASE`` words) those are marked that have the least hash in
   some window, so every window holds a marked phrase, and equal windows hold
   equal ones.  Marked phrases are counted over the corpus; the ones that recur
   are confirmed as repeated.
2. An occurrence whose surroundings (all windows over it) occurred earlier in
   whole settles those windows at once.  The other repeated phrases stay open.
3. Documents and their open phrases meet in the same partition; the phrases are
   compiled into Aho-Corasick automata, one per shard of documents, and all
   documents of the shard stream through it, which locates every occurrence.
   Only windows over one are compared between documents.
4. The windows' first occurrences are found by a partial minimum per window, so a
   passage in a third of all documents costs one row per task there; occurrences
   later than the first are removed.

Counts and minima are aggregated before they are shuffled, joins are equi-joins
whose hot keys Spark may split, and nothing is collected.

Defined cases: null text and text without words keep nothing and lose nothing;
documents shorter than a window are kept; rows with equal id and text are one
document (both are kept or lose the same words); null ids come after all others;
only the id and the text are read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.session import cut_lineage

from .textops import SPACE_WORDS, Words, prepare, text_slices, window_hash

WINDOW = 20
PHRASE = 5

#: ``at`` holds the place in its upper bits, then how far the surroundings reach before and behind it (a byte each).
_MARKS = "fp long, ctx long, k long, rk long, at long"
_LAST = (1 << 63) - 1


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i] .. first[i]+count[i]-1`` one after another."""
    if not len(first):
        return np.zeros(0, np.int64)
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))


def marked(words: Words, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, ...]:
    """Marked phrases of all texts: hash, hash of the surroundings, owner, place in the owner, and the surroundings' word range there."""
    n, span = len(words.start), window - phrase + 1
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    own = words.owner()
    h = window_hash(words.hash, np.arange(n - phrase + 1), np.arange(n - phrase + 1) + phrase)
    least = h
    step = 1
    while step < span:                                # minimum of ever longer runs
        d = min(step, span - step)
        least = np.minimum(least[:len(least) - d], least[d:])
        step += d
    least = np.where(own[:n - window + 1] == own[window - 1:], least, np.uint64(0))
    most = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    step = 1
    while step < span:
        d = min(step, span - step)
        most = np.maximum(most[:len(most) - d], most[d:])
        step += d
    at = np.flatnonzero((most == h) & (h > 0))
    owner = own[at].astype(np.int64)
    lo = np.maximum(at - (window - phrase), words.first[owner])
    hi = np.minimum(at + window, words.first[owner + 1])
    ctx = window_hash(words.hash, lo, hi) ^ ((at - lo).astype(np.uint64) << np.uint64(32))
    base = words.first[owner]
    return h[at], ctx, owner, at - base, lo - base, hi - base


def _mark(docs: DataFrame, window: int, phrase: int, only_hash: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_numpy(zero_copy_only=False)
            rks = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, off, data in text_slices(batch):
                fp, ctx, owner, pos, lo, hi = marked(Words(off, data, SPACE_WORDS, False), window, phrase)
                cols = [pa.array(fp.view(np.int64))]
                if not only_hash:
                    cols += [pa.array(ctx.view(np.int64)), pa.array(ks[i:j][owner]), pa.array(rks[i:j][owner]),
                             pa.array(pos << 16 | (pos - lo) << 8 | (hi - pos))]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _MARKS.split(", ")][:len(cols)])

    return docs.mapInArrow(run, "fp long" if only_hash else _MARKS)


def _open_windows(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """Hash and place of every window over an open phrase's occurrence that is not settled."""
    import ahocorasick

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_numpy(zero_copy_only=False)
            rks = batch.column(1).to_numpy(zero_copy_only=False)
            opens, spans = batch.column(3), batch.column(4)
            for i, j, off, data in text_slices(batch):
                words = Words(off, data, SPACE_WORDS, False)
                automaton, size = ahocorasick.Automaton(), 0
                for d in range(j - i):
                    for p in opens[i + d].as_py() or ():
                        automaton.add_word(_line(words, int(words.first[d]) + p, phrase), 1)
                        size += 1
                if not size:
                    continue
                automaton.make_automaton()
                starts, owner = [], []
                for d in range(j - i):
                    first, n = int(words.first[d]), int(words.count[d])
                    if n < window:
                        continue
                    lengths = words.end[first:first + n] - words.start[first:first + n]
                    ends = np.cumsum(lengths + 1)                     # place of the blank after each word
                    got = np.fromiter((e for e, _ in automaton.iter(_line(words, first, n))), np.int64)
                    if not len(got):
                        continue
                    pos = np.searchsorted(ends, got) - phrase + 1     # the phrase's first word
                    over = np.zeros(n - window + 2, np.int64)
                    np.add.at(over, np.maximum(pos - (window - phrase), 0), 1)
                    np.add.at(over, np.minimum(pos, n - window) + 1, -1)
                    wanted = np.cumsum(over[:-1]) > 0
                    for lo, hi in spans[i + d].as_py() or ():
                        wanted[lo:hi - window + 1] = False
                    at = np.flatnonzero(wanted)
                    starts.append(at)
                    owner.append(np.full(len(at), d))
                if starts:
                    at, own = np.concatenate(starts), np.concatenate(owner)
                    begin = at + words.first[own]
                    h = window_hash(words.hash, begin, begin + window)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(ks[i:j][own]), pa.array(rks[i:j][own]), pa.array(at.astype(np.int32))], ["wh", "k", "rk", "start"])

    return docs.mapInArrow(run, "wh long, k long, rk long, start int")


def _line(words: Words, first: int, n: int) -> str:
    """Words of one text between blanks; bytes stand for themselves as Latin-1 characters."""
    raw = words.data[words.start[first]:words.end[first + n - 1]].tobytes()
    return " " + b" ".join(raw.split()).decode("latin-1") + " "


def _result(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Words, removed words and the digest (or text) of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            spans, starts = batch.column(2), batch.column(3)
            out = []
            for d in range(batch.num_rows):
                words = (texts[d].as_py() or b"").split()
                n, gone = len(words), 0
                cuts = [*(spans[d].as_py() or ()), *((s, s + window) for s in starts[d].as_py() or ())]
                if cuts:
                    over = np.zeros(n + 1, np.int64)
                    cut = np.array(cuts, np.int64)
                    np.add.at(over, cut[:, 0], 1)
                    np.add.at(over, cut[:, 1], -1)
                    keep = np.cumsum(over[:-1]) == 0
                    gone = n - int(keep.sum())
                    words = [w for w, x in zip(words, keep.tolist()) if x]
                kept = b" ".join(words)
                out.append((n, gone, kept.decode() if with_text else hashlib.sha256(kept).hexdigest()))
            n, gone, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def deduplicate(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, with_text: bool = False) -> DataFrame:
    """Per document: words, removed words, and SHA-256 (or text) of the kept words joined by blanks."""
    if window - phrase > 255:
        raise ValueError("a window reaches at most 255 words beyond its phrase")
    prepare(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("k"), F.xxhash64("text").alias("rk"),
                      F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    keyed = own.select("k", "rk", "text")
    repeated = _mark(keyed, window, phrase, True).groupBy("fp").count().where("count > 1").select("fp")
    occ = cut_lineage(_mark(keyed, window, phrase, False).join(repeated, "fp", "left_semi"))

    # equal surroundings reach equally far, so places compare as their packed form does
    earliest = occ.groupBy("fp", "ctx").agg(F.min(F.struct("k", "at")).alias("first"))
    settled = F.struct("k", "at") > F.col("first")
    pos = F.shiftright("at", 16).cast("int")
    span = F.array(pos - F.shiftright("at", 8).bitwiseAND(255).cast("int"), pos + F.col("at").bitwiseAND(255).cast("int"))
    plan = occ.join(earliest, ["fp", "ctx"]).groupBy("k", "rk").agg(
        F.collect_set(F.when(~settled, pos)).alias("open"), F.collect_set(F.when(settled, span)).alias("spans"))
    plan = cut_lineage(plan)

    both = own.join(plan.hint("shuffle_hash"), ["k", "rk"], "left")
    found = cut_lineage(_open_windows(both.where(F.size("open") > 0).select("k", "rk", "text", "open", "spans"), window, phrase))
    first = found.groupBy("wh").agg(F.min(F.struct("k", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = found.join(first, "wh").where(F.struct("k", "start") > F.col("first"))
    starts = later.groupBy("k", "rk").agg(F.collect_set("start").alias("starts"))
    cuts = plan.select("k", "rk", "spans").join(starts, ["k", "rk"], "left")
    done = own.join(cuts.hint("shuffle_hash"), ["k", "rk"], "left").select("doc_id", "text", "spans", "starts")
    out = _result(done, window, with_text)
    return out.withColumnRenamed("kept", "text" if with_text else "kept_sha256")
