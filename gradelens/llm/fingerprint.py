"""Merkle-tree fingerprints of documents.

A text is a tree: sections hold paragraphs (lines), paragraphs hold sentences.
A sentence's digest covers its characters, a paragraph's the digests of its
sentences, a section's those of its paragraphs, and the root those of the
sections; a section ends where a paragraph's digest says so, so an edit moves no
boundary elsewhere.  Equal roots mean equal texts; where roots differ, walking
down only the differing branches locates the edit.

The fingerprint is the tree in writing: the root, then for each section its
digest and its paragraphs, for each of these its digest and its sentences, as
short digest and length.  ``likeness`` compares two of them by the characters of
the sentences they share; ``edits`` lists the differing paragraphs.

Defined cases: null and empty texts have the tree of one empty sentence; repeated
rows have equal fingerprints; rows of one id follow each other by the hashes of their
texts; a lone document is its own next one; an empty table has no rows; a very long text is
one tree that its task holds whole, about 30 characters a sentence; of the documents' columns
only the id and the text are read, ``fingerprints`` replaces a column of that name.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import prepare

#: A paragraph ends a section when its digest is a multiple of this.
SECTION = 4
#: Longest sentence; longer ones are cut.
SENTENCE = 400
_SENTENCES = re.compile(r"[^.!?]{1,%d}(?:[.!?]+\s*)?|[.!?]+\s*" % SENTENCE, re.S)


def _digest(parts: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def tree(text: str | None, known: dict[str, bytes] | None = None) -> str:
    """The text's Merkle tree in writing: ``root|section:paragraph,sentence.length,...;paragraph...|section...``."""
    known = {} if known is None else known
    written, sections, paras, digests = [], [], [], []
    lines = (text or "").split("\n")
    for k, line in enumerate(lines):
        leaves, shown = [], []
        for s in _SENTENCES.findall(line) or [""]:
            d = known.get(s)
            if d is None:
                d = known[s] = hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            leaves.append(d)
            shown.append(f"{d[:8].hex()}.{len(s)}")
        p = _digest(leaves)
        digests.append(p)
        paras.append(p[:4].hex() + "," + ",".join(shown))
        if p[0] % SECTION == 0 or k == len(lines) - 1:
            s = _digest(digests)
            sections.append(s)
            written.append(s[:4].hex() + ":" + ";".join(paras))
            paras, digests = [], []
    return hashlib.sha256(b"".join(sections)).hexdigest()[:32] + "|" + "|".join(written)


def _leaves(section: str) -> list[list[str]]:
    return [p.split(",")[1:] for p in section.partition(":")[2].split(";")]


def likeness(a: str, b: str) -> float:
    """Share of the characters (and line ends) that lie in sentences both have, from 0 to 1; 1 only for equal roots."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = a.split("|")[1:], b.split("|")[1:]
    same, total = 0, 0
    left: dict[str, int] = {}
    alike = set(x) & set(y) if len(set(x)) == len(x) and len(set(y)) == len(y) else set()
    for side, sections in ((1, x), (-1, y)):
        for s in sections:
            for para in _leaves(s):
                for leaf in para:
                    size = int(leaf.rpartition(".")[2])
                    total += size
                    if s in alike:                          # equal branches need no look inside
                        same += size
                    elif side > 0:
                        left[leaf] = left.get(leaf, 0) + 1
                    elif left.get(leaf, 0):
                        left[leaf] -= 1
                        same += 2 * size
    return min(same / total, 1 - 1e-9) if total else 0.0


def edits(a: str, b: str) -> list[int]:
    """Numbers of the paragraphs of ``b`` that ``a`` doesn't have, found below differing sections only."""
    if a[:32] == b[:32]:
        return []
    x = a.split("|")[1:]
    have, paras = set(x), {p for s in x for p in s.partition(":")[2].split(";")}
    out, k = [], 0
    for s in b.split("|")[1:]:
        below = s.partition(":")[2].split(";")
        if s not in have:
            out += [k + i for i, p in enumerate(below) if p not in paras]
        k += len(below)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its fingerprint."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def of(text):
        return text.map(tree)

    return docs.withColumn("fingerprint", of(F.col(text_col)))


class Ranges:
    """Ranges of about equal counts over rows ``(k, n)``: by ``k``, and by ``n`` where one ``k`` fills several."""

    def __init__(self, rows: DataFrame, parts: int):
        probs = [i / parts for i in range(1, parts)]
        cuts = rows.agg(F.percentile_approx("k", F.array(*[F.lit(p) for p in probs]), 10 * parts).alias("c")).first()["c"] if probs else []
        #: upper bounds, ``m`` equal ones of ``k`` parted evenly in ``n``, which is a hash
        self.k, times = np.unique(np.asarray(cuts if cuts is not None else [], np.int64), return_counts=True)
        self.first = np.concatenate([[0], np.cumsum(times)])
        self.n = [np.array([(i << 64) // m - (1 << 63) for i in range(1, m)], np.int64) for m in times.tolist()]

    def place(self, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The range of each row."""
        own = np.searchsorted(self.k, k, "left")
        out = self.first[own]
        for i in np.unique(own[own < len(self.k)]).tolist():
            if len(self.n[i]):
                at = np.flatnonzero((own == i) & (k == self.k[i]))
                out[at] += np.searchsorted(self.n[i], n[at], "right")
        return out


def _targets(rows: DataFrame, parts: int):
    """Arrow UDF of ``k, n``: the row's range, and for a range's largest row also the range above."""
    ranges = Ranges(rows, parts)

    @F.arrow_udf("int")
    def place(k: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array(ranges.place(k.to_numpy(), n.to_numpy()), pa.int32())

    tops = rows.groupBy(place("k", "n").alias("p")).agg(F.max(F.struct("k", "n")).alias("top")).orderBy("p").collect()
    above = {(r["top"]["k"], r["top"]["n"]): tops[(i + 1) % len(tops)]["p"] for i, r in enumerate(tops)}

    @F.arrow_udf("array<int>")
    def targets(k: pa.Array, n: pa.Array) -> pa.Array:
        own = ranges.place(k.to_numpy(), n.to_numpy()).tolist()
        return pa.array([[p, above[row]] if row in above else [p] for p, row in zip(own, zip(k.to_pylist(), n.to_pylist()))], pa.list_(pa.int32()))

    return targets("k", "n")


def with_next(docs: DataFrame, fn, schema: str) -> DataFrame:
    """Rows ``fn(doc_id, text, next text)`` over documents by falling id; the last one's next is the first.

    Rows are cut into ranges of ids, and inside an id that many rows have (or the
    null id) into ranges of the texts' hashes; every range is one run of rows sorted in
    its task and streamed.  A range's largest row also goes to the range above, whose
    last row it follows, so one shuffle of the texts is enough.  Rows of the same id
    stand in the order of their texts' hashes; null ids come last.  Only rows equal in
    both id and text always share a range.
    """
    spark = prepare(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")) \
        .withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("n", F.bitwise_not(F.xxhash64("text")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.select("k", "n", "doc_id", "text", F.posexplode(_targets(keyed.select("k", "n"), parts)).alias("ghost", "target")) \
        .repartition(parts, "target").sortWithinPartitions("target", "ghost", F.desc("k"), F.desc("n")) \
        .select("target", "ghost", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            rows = []
            for target, ghost, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] == target and not held[1]:
                    rows.append(fn(held[2], held[3], text))
                held = (target, ghost, doc_id, text)
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])

    return dealt.mapInArrow(run, schema)


EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (second half from the next document), and their likeness."""

    def of(doc_id, text: str, following: str):
        known: dict[str, bytes] = {}
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        a, b = tree(text, known), tree(edited, known)
        return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, tree(following)))

    return with_next(docs, of, EDIT_SCHEMA)
