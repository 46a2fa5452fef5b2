"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window.

Benchmark texts are normalised to words; every run of ``n`` words (or the whole
item, when it is shorter) is a window.  Spark tasks normalise the items and cut long
ones into pieces that overlap by ``n - 1`` words, so that every window lies in one
piece.  Pieces are dealt to shards of about ``SHARD_BYTES`` and the driver holds
one shard at a time: it sorts the hashes of the shard's windows and broadcasts them
with the pieces.  A task hashes all word windows of its documents, looks them up, and
verifies each hit against the window's words.  Nothing of the documents is shuffled.

With one shard (the usual case) the documents are scanned once.  With more, every
shard scans them in tasks of its own, so no task holds two shards, and the texts with
hits, which are few, are joined to the documents by two hashes of the text.

Defined cases: null text and text without words have no windows; an item without
words or without an id matches nothing; an empty benchmark hits nothing; repeated items
are one item (by id), items that share a window are all found by it; repeated
documents are judged row by row; an empty table of documents has no rows; a very long
item is several pieces, a very long document is one text that its task holds whole;
other columns of the documents pass through untouched, whatever they are called.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.session import cut_lineage

from .textops import ALNUM_WORDS, LOWER, SLICE_BYTES, Words, prepare, text_slices, window_hash

WINDOW = 10
SHARD_BYTES = 16 << 20
#: Words of a piece of a long item.
PIECE = 4096

_TO_WORDS = bytes(LOWER[b] if ALNUM_WORDS[LOWER[b]] else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then the runs of digits, letters and non-ASCII characters."""
    return text.translate(_TO_WORDS).split()


class WindowSet:
    """Sorted hashes of the windows of a shard's pieces, by length, with their words and items."""

    def __init__(self, pieces: list[tuple[str, bytes]], n: int):
        """``pieces``: items and their words, one blank between two."""
        self.names = sorted({item for item, _ in pieces})
        self.text = b" ".join([t for _, t in pieces] + [b""])
        number = {item: i for i, item in enumerate(self.names)}
        item_of = np.array([number[item] for item, _ in pieces], np.int32)
        off = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in pieces])]).astype(np.int64)
        rows, i = [], 0
        while i < len(pieces):
            j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
            rows.append(self._windows(off[i:j + 1], item_of[i:j], n))
            i = j
        hashes, size, start, end, item = (np.concatenate(x) for x in zip(*rows)) if rows else [np.zeros(0, np.int32)] * 5
        #: window length: hashes, sorted, and of each the bytes it takes and the item
        self.by_size: dict[int, tuple[np.ndarray, ...]] = {}
        for s in np.unique(size).tolist():
            at = np.flatnonzero(size == s)
            at = at[np.lexsort((item[at], hashes[at]))]
            self.by_size[s] = (hashes[at], start[at], end[at], item[at])

    def _windows(self, off: np.ndarray, item_of: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Hash, length, bytes and item of the windows of some consecutive pieces."""
        base = int(off[0])
        words = Words(off - base, np.frombuffer(self.text, np.uint8, int(off[-1]) - base, base), ALNUM_WORDS, False)
        owner, at = words.owner(), np.arange(len(words.start))
        left = words.first[1:][owner] - at
        at = at[(left >= n) | (words.count[owner] < n) & (at == words.first[:-1][owner])]
        size = np.minimum(left[at], n)
        return (window_hash(words.hash, at, at + size), size.astype(np.int32), (words.start[at] + base).astype(np.int32),
                (words.end[at + size - 1] + base).astype(np.int32), item_of[owner[at]])

    def hits(self, words: Words) -> list[tuple[int, int, tuple[int, ...]]]:
        """``(word index, size, items)`` of every verified occurrence."""
        out, known = [], {}
        for size, (hashes, start, end, item) in self.by_size.items():
            got, inside = words.windows(size)
            if not len(got):
                continue
            lo = np.searchsorted(hashes, got, "left")
            found = np.flatnonzero((hashes[np.minimum(lo, len(hashes) - 1)] == got) & inside)
            hi = np.searchsorted(hashes, got[found], "right")
            for i, a, b in zip(found.tolist(), lo[found].tolist(), hi.tolist()):
                seq = b" ".join([words.data[x:y].tobytes() for x, y in zip(words.start[i:i + size], words.end[i:i + size])])
                if (size, seq) not in known:
                    same = [k for k in range(a, b) if self.text[start[k]:end[k]] == seq]
                    known[size, seq] = tuple(np.unique(item[same]).tolist())
                if known[size, seq]:
                    out.append((i, size, known[size, seq]))
        return out


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``item, words, size``: the items' words, long items in pieces that overlap by ``n - 1`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words_of(text.as_py())
                cut = [b" ".join(w[i:i + PIECE + n - 1]) for i in range(0, max(1, len(w) - n + 1), PIECE)] if w else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(cut), pa.string()), pa.array(cut, pa.binary()), pa.array([len(t) + 1 for t in cut], pa.int64())],
                    ["item", "words", "size"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.dropna().mapInArrow(run, "item string, words binary, size long").distinct()


def _shards(benchmark: DataFrame, id_col: str, text_col: str, n: int, most: int) -> Iterator[Broadcast]:
    """Broadcast window sets of about ``most`` bytes of pieces each, built one after another."""
    pieces = cut_lineage(_pieces(benchmark, id_col, text_col, n))
    count = max(1, -(-(pieces.agg(F.sum("size")).first()[0] or 0) // most))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(count)))
    for shard in range(count):
        rows = dealt.where(F.col("shard") == shard).select("item", "words").toArrow()
        windows = WindowSet(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())), n)
        if windows.by_size or not shard:
            yield benchmark.sparkSession.sparkContext.broadcast(windows)


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents with a struct ``_hit`` (see ``_named``): word count, hit words, items with hits."""
    prepare(docs.sparkSession)
    shards = list(_shards(benchmark, item_col, item_text, n, shard_bytes))
    text, name = F.col(text_col).cast("binary"), _named(docs)
    hit = docs.withColumn(name, _scan(shards[0])(text))
    if len(shards) == 1:
        return hit
    key = F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text))
    scans = [docs.select(key.alias("key"), _scan(shard)(text).alias("h")).where(F.size("h.hit") > 0) for shard in shards[1:]]
    more, found = _named(docs, "_more"), _named(docs, "_key")
    others = reduce(DataFrame.union, scans).groupBy("key").agg(F.collect_set("h").alias(more)).withColumnRenamed("key", found)

    def joined(field: str):
        rest = F.flatten(F.coalesce(F.col(f"{more}.{field}"), F.array()))
        return F.array_sort(F.array_distinct(F.concat(F.col(f"{name}.{field}"), rest))).alias(field)

    merged = F.struct(F.col(f"{name}.n_words").alias("n_words"), joined("hit"), joined("items"))
    return hit.withColumn(found, key).join(others, found, "left").select(*[F.col(f"`{c}`") for c in docs.columns], merged.alias(name))


def _named(docs: DataFrame, name: str = "_hit") -> str:
    """The name of the struct that ``find`` adds: ``_hit``, longer if the documents have a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


_HIT = "struct<n_words: bigint, hit: array<int>, items: array<string>>"


def _scan(held: Broadcast):
    """Arrow UDF over text bytes: words, indices of hit words, items."""

    def scan(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = held.value
        for col in it:
            batch = pa.RecordBatch.from_arrays([col], ["text"])
            counts, hit, items = [], [], []
            for _, _, off, data in text_slices(batch):
                words = Words(off, data, ALNUM_WORDS, True)
                counts.append(words.count)
                found: dict[int, tuple[set, set]] = {}
                hits = windows.hits(words)
                if hits:
                    owners = np.searchsorted(words.first, [h[0] for h in hits], "right") - 1
                    for (i, size, which), d in zip(hits, owners.tolist()):
                        at, numbers = found.setdefault(d, (set(), set()))
                        at.update(range(i - int(words.first[d]), i - int(words.first[d]) + size))
                        numbers.update(which)
                for d in range(len(words.count)):
                    at, numbers = found.get(d, ((), ()))
                    hit.append(sorted(at))
                    items.append([windows.names[k] for k in sorted(numbers)])
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                ["n_words", "hit", "items"])

    from pyspark.sql.functions import arrow_udf
    scan.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(scan, _HIT)


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items with hits, a digest of the items, and whether it is contaminated."""
    hit = find(docs.select("doc_id", "text"), benchmark, n)
    return hit.select(
        "doc_id", F.col("_hit.n_words").alias("n_words"), F.size("_hit.hit").cast("long").alias("n_hit"),
        F.size("_hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hit.items", ","), 256).alias("items_sha256"), (F.size("_hit.hit") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, spans: bool = False, most: float = 0.0) -> DataFrame:
    """Drop documents with hits, or with ``spans`` cut the hit words out and drop documents that lose over ``most`` of their words."""
    hit, name = find(docs, benchmark, n), _named(docs)
    at, n_words = F.col(f"{name}.hit"), F.col(f"{name}.n_words")
    if not spans:
        return hit.where(F.size(at) <= most * n_words).drop(name)

    @F.pandas_udf("string")
    def cut(text, at):
        return pd.Series([None if t is None else cut_words(t, a) for t, a in zip(text, at)], dtype=object)

    kept = hit.where((F.size(at) == 0) | (F.size(at) <= most * n_words))
    text = F.when(F.size(at) > 0, cut(F.col("text"), at)).otherwise(F.col("text"))
    return kept.withColumn("text", text).drop(name)


def cut_words(text: str, at) -> str:
    """``text`` without the words numbered ``at``, and without the white space after each."""
    raw = text.encode()
    words = Words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), ALNUM_WORDS, True)
    out, last = [], 0
    for i in at:
        out.append(raw[last:words.start[i]])
        last = int(words.end[i])
        while last < len(raw) and raw[last:last + 1].isspace():
            last += 1
    return (b"".join(out) + raw[last:]).decode()


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
