"""What each quality filter removes, in every order the filters may be applied.

Every filter has a sorted posting list of the documents that fail it, per part of
the data and per range of document ids.  Inside a range the lists are merged:
unions of any set of filters, and the difference of one filter's list and such a
union, by galloping (the shorter list's ids are searched in the longer one).  The
sizes of these lists add up over the ranges, and every order's steps are read
off them: what a filter removes after the filters of a set S is its list less the
union of S's lists.

Shape of the job: one pass over the texts leaves a narrow table (part, id, hash of the
text, failures); copies are found by the least id of a hash, first within
``SALTS`` buckets, so that a text that fills a third of the table is spread; ranges of
(part, id) are dealt to tasks, each of which holds one Arrow batch of ids and 80
sums of the part at hand.  Texts don't leave the first pass.

Defined cases: a null text is empty, a null part is ``''``; a document without an id counts like
any other, carries no labels and is no copy of another (nor is another of it); rows that share an
id are documents of their own, and of equal texts none is smaller than the other; a document
labelled twice is good (toxic) if either label says so; null labels say nothing; other columns
are not read, whatever their names; texts of any length are judged whole; an empty table
has no parts and no rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelens.session import cut_lineage

from .textops import prepare

SALTS = 256
_WORD = r"[^\x20\x09-\x0D]+"

#: letter -> condition of failure over the columns text, words and later_copy
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.size("words") < 50,
    "B": lambda: 100 * F.size(F.array_distinct("words")) < 65 * F.size("words"),
    "C": lambda: 100 * (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 5 * F.length("text"),
    "D": lambda: F.col("text").rlike("[#$%&*|]"),
    "E": lambda: F.col("later_copy"),
}


def gallop(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each of the sorted ``ids``, whether the sorted list ``among`` holds it.

    Both lists are sorted, so every search starts from the place of the one before.
    """
    if not len(among):
        return np.zeros(len(ids), bool)
    at = np.searchsorted(among, ids)
    at[at == len(among)] = 0
    return among[at] == ids


def union(lists: list[np.ndarray]) -> np.ndarray:
    """K-way union of sorted lists: from the longest on, each takes in the ids that it lacks at their places."""
    lists = sorted((x for x in lists if len(x)), key=len, reverse=True)
    if not lists:
        return np.zeros(0, np.int64)
    out = lists[0]
    for x in lists[1:]:
        new = x[~gallop(x, out)]
        if len(new):
            out = np.insert(out, np.searchsorted(out, new), new)
    return out


def merged_sizes(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """``[filter, set of earlier filters, (removed, good, toxic, failing, union with the filter)]`` of one range."""
    k = len(lists)
    unions = [np.zeros(0, np.int64)] * (1 << k)
    for s in range(1, 1 << k):
        unions[s] = union([lists[i] for i in range(k) if s >> i & 1])
    out = np.zeros((k, 1 << k, 5), np.int64)
    for f, own in enumerate(lists):
        for s in range(1 << k):
            if s >> f & 1:
                continue
            gone = own[~gallop(own, unions[s])]
            out[f, s] = len(gone), gallop(gone, good).sum(), gallop(gone, toxic).sum(), len(own), len(unions[s | 1 << f])
    return out


def _sums(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sums of the sizes over a task's ranges, part by part (the rows come in order of part and id)."""
    def rows(part, total, n):
        f, s = np.nonzero(np.arange(1 << k)[None, :] >> np.arange(k)[:, None] & 1 == 0)
        got = total[f, s]
        cols = [pa.array([part] * len(f), pa.string()), pa.array(f.astype(np.int32)), pa.array(s.astype(np.int32)),
                *[pa.array(got[:, i]) for i in range(5)], pa.array(np.full(len(f), n, np.int64))]
        return pa.RecordBatch.from_arrays(cols, ["part", "f", "earlier", "removed", "good", "toxic", "failing", "gone", "n"])

    part, total, n = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column(0).dictionary_encode() if not isinstance(batch.column(0), pa.DictionaryArray) else batch.column(0)
        codes = parts.indices.to_numpy(zero_copy_only=False)
        mask, marks = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(codes)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            name = parts.dictionary[int(codes[i])].as_py()
            if name != part:
                if part is not None:
                    yield rows(part, total, n)
                part, total, n = name, np.zeros((k, 1 << k, 5), np.int64), 0
            # a document's place in its range of ids stands for it: rows may share an id or have none
            lists = [np.flatnonzero(mask[i:j] >> f & 1) for f in range(k)]
            total += merged_sizes(lists, np.flatnonzero(marks[i:j] & 1), np.flatnonzero(marks[i:j] & 2))
            n += j - i
    if part is not None:
        yield rows(part, total, n)


def _first_of_text(rows: DataFrame) -> DataFrame:
    """``rows`` and ``first``, the least id of the row's text; shuffled by hash and bucket, never by the hash alone."""
    near = rows.groupBy("h", "salt").agg(F.min("doc_id").alias("m"), F.count("*").alias("c"))
    whole = near.groupBy("h").agg(F.min("m").alias("first"), F.sum("c").alias("c")).where("c > 1").select("h", "first")
    return rows.join(near.select("h", "salt").join(whole, "h"), ["h", "salt"], "left")


def failures(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[], Column]] = FILTERS, part: str = "source") -> DataFrame:
    """One narrow row per document: part, doc_id, salt, mask (bit i: fails filter i), marks (1 good, 2 toxic)."""
    names = list(filters)
    late = [f for f in names if f == "E"]
    text = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = text.withColumn("words", F.regexp_extract_all("text", F.lit(_WORD), 0))

    def mask(of):
        return sum((F.when(filters[f](), 1 << names.index(f)).otherwise(0) for f in of), F.lit(0)).cast("int")

    rows = cut_lineage(text.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("h"), mask(f for f in names if f not in late).alias("mask"),
                                   F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int").alias("salt")))
    if late:
        rows = _first_of_text(rows).withColumn("later_copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
        rows = rows.withColumn("mask", F.col("mask") + mask(late))
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc_id"))
             .agg((F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("marks"))
             .withColumn("spread", F.lit(0)))
    # rows without an id match nothing; their second key deals them to all tasks
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("salt") + 1).otherwise(0))
    return rows.join(marks, ["doc_id", "spread"], "left").select("part", "doc_id", "salt", "mask", F.coalesce("marks", F.lit(0)).cast("int").alias("marks"))


def sizes(rows: DataFrame, k: int) -> DataFrame:
    """Sizes of merged posting lists per part, filter and set of earlier filters, from the rows of ``failures``."""
    rows = cut_lineage(rows)                   # dealing by ranges reads its input twice
    dealt = rows.repartitionByRange("part", "doc_id", "salt").sortWithinPartitions("part", "doc_id")
    prepare(rows.sparkSession)
    sums = dealt.select("part", "mask", "marks").mapInArrow(
        lambda it: _sums(it, k), "part string, f int, earlier int, removed long, good long, toxic long, failing long, gone long, n long")
    return sums.groupBy("part", "f", "earlier").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic", "failing", "gone", "n")])


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[], Column]] = FILTERS, part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed and lost there, and the filter's Shapley sum."""
    names, k = "".join(filters), len(filters)
    got = sizes(failures(docs, labels, filters, part), k)
    every = (1 << k) - 1
    # in |S|! (k - 1 - |S|)! orders a filter comes right after the set S
    orders = {s: factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) for s in range(every + 1) if s != every}
    weight = F.element_at(F.create_map(*[F.lit(x) for s, n in orders.items() for x in (s, n)]), F.col("earlier"))
    own = Window.partitionBy("part", "f")
    got = got.withColumn("shapley", F.sum(F.col("removed") * weight).over(own)) \
        .withColumn("unique_fails", F.max(F.when(F.col("earlier") == F.lit(every) - F.expr("shiftleft(1, f)"), F.col("removed"))).over(own))
    steps = []
    for order in permutations(range(k)):
        name = "".join(names[f] for f in order)
        steps += [(name, i + 1, f, sum(1 << g for g in order[:i])) for i, f in enumerate(order)]
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, earlier int")
    return got.join(steps, ["f", "earlier"]).select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
