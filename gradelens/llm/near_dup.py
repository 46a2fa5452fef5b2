"""MinHash near-duplicates by an inverted join over signature coordinates.

1. A document's set is its distinct 5-word shingles; documents of equal sets are
   one *text* from here on.  A text's signature has ``COORDS`` coordinates, each the
   least value of the set under one hash function.
2. A text is posted under its coordinate-value pairs.  All pairs are put in one order,
   rarest first; two texts that agree on ``MATCHES`` of them share at least one of the
   ``COORDS - MATCHES + 1`` that come first in either, so only this prefix is posted.  The
   order comes from counts of all pairs of all texts in a table of ``SLOTS`` places (pairs
   that share a place share its count); any order loses nothing, and this one
   keeps pairs that many texts have out of the prefixes.
3. Lists of one text are skipped, and of lists of the same texts all but one.  The
   collisions of two signatures of a list are counted over all coordinates, and pairs of
   at least ``MATCHES`` are kept, as a spanning forest.  A list of more than ``LIST_BLOCK``
   texts is dealt to blocks twice, by two hashes, and a text is compared inside its two blocks.  Texts that
   this connects need no further comparison.  Where it leaves several parts of a list, the
   texts outside the largest part are compared with all others, block by block.
4. The forests make families.  Inside a family links are confirmed on the full shingle
   sets, in the same two steps, and again only spanning forests are returned; their
   components are the classes.

``MATCHES`` is four standard deviations under the expected number of equal
coordinates at the wanted similarity (92 of 128 for 85 %), so about one borderline
link in 20,000 is missed.

Defined cases: null text, empty text and text without words have an empty set
and are linked with nothing; a text of fewer than five words has one shingle, all
its words; repeated rows and ids are one text and stay rows of their own; a null
id is never the smallest of a class that has another; an empty table has no rows; a
very long text is one set of up to 8 bytes a word, which its task holds whole; other
columns are neither read nor changed, whatever they are called.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens.session import cut_lineage

from .components import components
from .textops import SPACE_WORDS, Words, mix, prepare, text_slices, window_hash

SHINGLE = 5
PERCENT = 80
COORDS = 128
#: Places of the table of pair counts, which is collected and broadcast.
SLOTS = 1 << 18
#: Texts of a posting list, and texts or shingles of a family, that one block holds.
LIST_BLOCK = 512
FAMILY_BLOCK = 512
FAMILY_SHINGLES = 400_000

_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)


def shingle_sets(off: np.ndarray, data: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after another and sorted, and where each text's begin."""
    words = Words(off, data, SPACE_WORDS, True)
    own = words.owner()
    n = len(own)
    begin = np.arange(n)
    left = words.first[1:][own] - begin                 # words from here to the text's end
    whole = (words.count[own] < size) & (begin == words.first[:-1][own])
    at = begin[(left >= size) | whole]
    h = window_hash(words.hash, at, at + np.minimum(left[at], size))
    owner = own[at].astype(np.int64)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(off)))


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 coordinates of 32 bits and a 64-bit name for each non-empty set."""
    begin = first[:-1][np.diff(first) > 0]
    sig = np.empty((len(begin), COORDS), np.uint32)
    for i in range(COORDS):
        sig[:, i] = np.minimum.reduceat(h * _MUL[i] + _ADD[i], begin) >> np.uint64(16) & np.uint64(0xFFFFFFFF)
    names = mix(np.add.reduceat(mix(h), begin) ^ np.diff(first)[np.diff(first) > 0].astype(np.uint64))
    return sig, names.view(np.int64)


def least_matches(percent: int) -> int:
    """Equal coordinates that a pair of that similarity has but for one in 20,000."""
    p = percent / 100
    return max(1, int(COORDS * p - 4 * (COORDS * p * (1 - p)) ** 0.5))


def _signed(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, off, data in text_slices(batch):
                h, first = shingle_sets(off, data, size)
                n = np.diff(first)
                if len(h):
                    sig, names = signatures(h, first)
                else:
                    sig, names = np.zeros((0, COORDS), np.uint32), np.zeros(0, np.int64)
                node = np.zeros(j - i, np.int64)
                node[n > 0] = names
                packed = np.full(j - i, None, object)
                packed[n > 0] = [x.tobytes() for x in sig]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(node, mask=n == 0), pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "rk", "node", "n_shingles", "sig"])

    return docs.mapInArrow(run, "doc_id long, rk long, node long, n_shingles long, sig binary")


def _unpacked(packed: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), np.uint32).reshape(len(packed), COORDS)


def pair_names(sig: np.ndarray) -> np.ndarray:
    """64-bit name of every coordinate-value pair."""
    return mix(sig.astype(np.uint64) | np.arange(1, COORDS + 1, dtype=np.uint64) << np.uint64(32))


def _slot(names: np.ndarray) -> np.ndarray:
    return (names & np.uint64(SLOTS - 1)).astype(np.int64)


def pair_counts(texts: DataFrame) -> np.ndarray:
    """How many pairs of all texts fall to each of the ``SLOTS`` places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(_slot(pair_names(_unpacked(batch.column(0)))).ravel(), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["slot", "n"])

    got = texts.select("sig").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return np.minimum(counts, 2**32 - 1).astype(np.uint32)


def prefixes(sig: np.ndarray, counts: np.ndarray, matches: int) -> np.ndarray:
    """Names of the pairs that each signature is posted under: the first ones by count, then name, then coordinate."""
    names = pair_names(sig)
    key = counts[_slot(names)].astype(np.uint64) << np.uint64(32) | names >> np.uint64(32)
    order = np.argsort(key, axis=1, kind="stable")[:, :COORDS - matches + 1]
    return np.take_along_axis(names, order, 1)


def _posted(texts: DataFrame, matches: int) -> DataFrame:
    """``key, node``: every text under the pairs of its prefix."""
    counts = texts.sparkSession.sparkContext.broadcast(pair_counts(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                keys = prefixes(_unpacked(part.column(1)), counts.value, matches)
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], ["key", "node"])

    return texts.select("node", "sig").mapInArrow(run, "key long, node long")


def _blocks(texts: str, shingles: str | Column, block: int) -> Column:
    """Blocks that so many texts with so many shingles together need."""
    shingles = F.col(shingles) if isinstance(shingles, str) else shingles
    return F.greatest(F.ceil(F.col(texts) / block), F.ceil(shingles / FAMILY_SHINGLES), F.lit(1)).cast("long")


def _spanned(rows: DataFrame, compare: Callable[[DataFrame], DataFrame], block: int) -> DataFrame:
    """Edges that connect, for every key, the texts that links connect.

    ``rows``: ``key, node, n`` (shingles), ``load`` and ``blocks``, the blocks that the key
    needs; ``compare`` returns a spanning forest of the links of each group ``key, bi, bj``.
    """
    def compared(groups: DataFrame) -> DataFrame:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = groups.select("key", "bi", "bj", "node", "load").repartition(parts, "key", "bi", "bj")
        return cut_lineage(compare(own.sortWithinPartitions("key", "bi", "bj", "node")).distinct())

    deals = F.sequence(F.lit(0).cast("long"), F.when(F.col("blocks") > 1, 1).otherwise(0).cast("long"))
    dealt = rows.withColumn("bj", F.explode(deals)) \
        .withColumn("bi", F.pmod(F.xxhash64("bj", "key", "node"), F.col("blocks")))
    edges = compared(dealt)
    long = rows.where("blocks > 1")
    if long.isEmpty():
        return edges

    labelled = long.join(components(edges), "node", "left").withColumn("part", F.coalesce("root", "node"))
    parts = labelled.groupBy("key", "part").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    split = parts.groupBy("key").agg(
        F.max(F.struct("m", "part", "w")).alias("main"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.count("*").alias("parts")) \
        .where("parts > 1").select("key", F.col("main.part").alias("main"), F.col("main.m").alias("mm"), F.col("main.w").alias("mw"),
                                   (F.col("m") - F.col("main.m")).alias("rm"), (F.col("w") - F.col("main.w")).alias("rw"))
    sized = split.select("key", "main", _blocks("rm", "rw", block).alias("few"), _blocks("mm", "mw", block).alias("many"))
    in_main = F.col("part") == F.col("main")
    spot = F.xxhash64(F.lit("block"), "node")
    crossed = labelled.join(sized, "key") \
        .withColumn("own", F.when(in_main, F.col("few") + F.pmod(spot, F.col("many"))).otherwise(F.pmod(spot, F.col("few")))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(in_main, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)))) \
        .where("own <> other").withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
    return edges.union(compared(crossed)).distinct()


def forest(linked: np.ndarray) -> np.ndarray:
    """For each of the rows of a symmetric link matrix the first row it is connected with."""
    linked = linked | np.eye(len(linked), dtype=bool)
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of equal key columns (the first ``keys``), from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield _joined(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _collisions(rows: DataFrame, matches: int) -> DataFrame:
    """Forest of the pairs with ``matches`` equal coordinates, for groups of rows ``key, bi, bj, node, load`` (signatures)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for group in _groups(batches, 3):
            m = group.num_rows
            if m < 2:
                continue
            node = group.column(3).to_numpy(zero_copy_only=False)
            sig = _unpacked(group.column(4))
            linked = np.zeros((m, m), bool)
            for i in range(0, m, 64):
                linked[i:i + 64] = (sig[i:i + 64, None, :] == sig[None, :, :]).sum(2, dtype=np.uint8) >= matches
            label = forest(linked)
            at = np.flatnonzero(label != np.arange(m))
            if len(at):
                found.append((node[label[at]], node[at]))
                held += len(at)
            if held > 50_000:
                yield _edges(found)
                found, held = [], 0
        yield _edges(found)

    return rows.mapInArrow(run, "a long, b long")


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted hash arrays."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    used = np.bincount(column, minlength=len(values))
    out = np.zeros((m, m), np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    common = used > 1                                   # only these add to a pair
    number = np.cumsum(common) - 1
    inside = common[column]
    owner, column = owner[inside], number[column[inside]]
    width = max(64, (8 << 20) // max(1, m))
    for lo in range(0, int(common.sum()), width):
        at = (column >= lo) & (column < lo + width)
        x = np.zeros((m, min(width, int(common.sum()) - lo)), np.float32)
        x[owner[at], column[at] - lo] = 1
        got = np.rint(x @ x.T).astype(np.int64)
        np.fill_diagonal(got, 0)
        out += got
    return out


def _confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """Forest of the links that hold on full sets, for groups of rows ``key, bi, bj, node, load`` (sets)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for group in _groups(batches, 3):
            m = group.num_rows
            if m < 2:
                continue
            node = group.column(3).to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(x, np.uint64) for x in group.column(4).to_pylist()]
            inter = shared(sets)
            n = np.array([len(s) for s in sets], np.int64)
            label = forest(100 * inter >= percent * (n[:, None] + n[None, :] - inter))
            at = np.flatnonzero(label != np.arange(m))
            found.append((node[label[at]], node[at]))
            if len(found) >= 2000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return rows.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Full shingle sets of rows ``root, node, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, off, data in text_slices(batch):
                h, first = shingle_sets(off, data, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                     pa.array(np.diff(first), pa.int64()),
                     pa.array([h[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], ["root", "node", "n", "shingles"])

    return docs.mapInArrow(run, "root long, node long, n long, shingles binary")


def _known(name: str) -> Column:
    """Null ids after all others."""
    return F.coalesce(F.col(name), F.lit((1 << 63) - 1))


def rooted(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Per row: ``doc_id, rk`` (a 64-bit hash of the text), ``n_shingles`` and ``root``, the name of its class (null for an empty set)."""
    prepare(docs.sparkSession)
    matches = least_matches(percent)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("rk"))
    signed = cut_lineage(_signed(src, size))
    texts = cut_lineage(signed.where("node is not null").groupBy("node").agg(F.first("sig").alias("sig"), F.min(F.struct(_known("doc_id").alias("k"), "rk")).alias("of")))

    posted = _posted(texts, matches)
    lists = posted.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    unlike = lists.where("m > 1").groupBy("m", "x", "y").agg(F.min("key").alias("key"))
    members = cut_lineage(posted.join(unlike, "key").select("key", "node", _blocks("m", F.lit(0), LIST_BLOCK).alias("blocks")))
    candidates = members.join(texts.select("node", "sig"), "node").select("key", "node", F.lit(0).cast("long").alias("n"), F.col("sig").alias("load"), "blocks")
    family = components(_spanned(candidates, lambda rows: _collisions(rows, matches), LIST_BLOCK))

    chosen = family.join(texts.select("node", "of"), "node").select("root", "node", "of.k", "of.rk")
    owned = src.select(_known("doc_id").alias("k"), "rk", "text").join(chosen.hint("shuffle_hash"), ["k", "rk"]).select("root", "node", "text")
    sets = cut_lineage(_sets(owned, size))
    sizes = sets.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("w")).select("root", _blocks("m", "w", FAMILY_BLOCK).alias("blocks"))
    held = sets.join(sizes, "root").select(F.col("root").alias("key"), "node", "n", F.col("shingles").alias("load"), "blocks")
    linked = components(_spanned(held, lambda rows: _confirmed(rows, percent), FAMILY_BLOCK))

    return signed.join(linked, "node", "left").select("doc_id", "rk", "n_shingles", F.coalesce("root", "node").alias("root"))


def classes(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``."""
    rows = rooted(docs, percent, size)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One document of each class, with its columns: the one of the smallest id.

    Documents without a word are kept, rows equal in id and text once.
    """
    rows = rooted(docs, percent, size).select("root", _known("doc_id").alias("k"), "rk")
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("k", "rk")).alias("x")).select("x.k", "x.rk")
    keep = first.unionByName(rows.where("root is null").select("k", "rk")).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(_known("doc_id").alias("k"), F.xxhash64("text").alias("rk"), F.struct(*names).alias("row"))
    once = keyed.join(keep.hint("shuffle_hash"), ["k", "rk"]).groupBy("k", "rk").agg(F.first("row").alias("row"))
    return once.select("row.*")
