"""Alignment of the tokens of two tokenizers by their byte ranges.

The byte-level tokenizer (A) reads a blank and the text, the piece tokenizer (B) the
text, to which it adds the blank itself; so both cover the same bytes.  The tokens of
both are sorted together by start, the running maximum of their ends is taken, and a
group ends where a start reaches that maximum: there, and only there, tokens of both
end.  Within a group every token overlaps the last token of the other kind before it,
if that one's end lies beyond its start, and each overlapping pair is found so exactly once.

How many documents hold a pair of ids linked is counted over the corpus: each slice
of documents sends its distinct pairs once, with the number of its documents that
hold them, and gets the corpus counts back (``slices.with_answers``).  The best count
of an A id is a table of at most as many rows as A has ids.

Defined cases: a null or empty text, and one whose tokens don't give back its bytes,
has no tokens: zeros and an empty ``groups_sha256``; the strings of special tokens are
plain text; repeated rows (and ids) are documents of their own; a null id stays null;
ties for an A id's best pair all count; very long texts are encoded whole, a task holds
one slice or one text; an empty table gives no rows; only the id and the text are read.
"""
from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.session import cut_lineage

from .slices import listed, packed, slice_ids, unpacked, with_answers
from .textops import as_bytes, prepare, text_slices

SLICE = 8 << 20
#: Pre-token pieces whose ids a worker keeps.
KEEP_PIECES = 500_000
#: Characters on which all releases of Unicode agree what is a letter or a digit; other texts are split by the library.
_OTHER = re.compile(r"[^ \n!-~À-ɏ]")


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Token ids of a byte-level vocabulary; the ids of a repeated piece between splits are kept."""

    def __init__(self, path: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        import regex
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        self._split = regex.compile(pattern).findall if pattern else None
        self._kept: dict[str, bytes] = {}
        chars = byte_of_char()
        vocabulary = self._tok.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self._kept) > KEEP_PIECES:
            self._kept.clear()
        kept = self._kept
        cut = [None if self._split is None or _OTHER.search(t) else self._split(t) for t in texts]
        new = list({p for pieces in cut if pieces for p in pieces if p not in kept})
        for i in range(0, len(new), 2048):
            got = self._tok.encode_batch_fast(new[i:i + 2048], add_special_tokens=False)
            kept.update((p, array("I", e.ids).tobytes()) for p, e in zip(new[i:i + 2048], got))
        whole = (array("I", self._tok.encode(t, add_special_tokens=False).ids).tobytes() if pieces is None else b"".join(map(kept.__getitem__, pieces))
                 for t, pieces in zip(texts, cut))
        return [np.frombuffer(x, np.uint32) for x in whole]


class Pieces:
    """Token ids of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece
        self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(self._sp.id_to_piece(i)[3:5], 16)]) if self._sp.is_byte(i) else
                      self._sp.id_to_piece(i).replace("▁", " ").encode() for i in range(self._sp.vocab_size())]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(array("I", x), np.uint32) for x in self._sp.encode(texts, num_threads=1)]


class ByteTable:
    """The bytes of every id of a vocabulary, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.len = np.array([len(x) for x in tokens], np.int64)
        self._all = np.frombuffer(b"".join(tokens), np.uint8)
        self._start = np.r_[0, np.cumsum(self.len)[:-1]]

    def of(self, ids: np.ndarray) -> np.ndarray:
        n = self.len[ids]
        return self._all[np.repeat(self._start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def covering(ids: list[np.ndarray], table: ByteTable, raw: list[bytes]) -> np.ndarray:
    """Which of the texts are not empty and equal, with a blank before them, the bytes of their tokens."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    ends = np.cumsum([len(x) for x in ids])
    size = np.diff(np.r_[0, np.r_[0, np.cumsum(table.len[flat])][ends]])
    ok = np.array([len(x) + 1 if x else -1 for x in raw]) == size
    flat = np.concatenate([x for x, good in zip(ids, ok) if good] or [flat[:0]])
    differ = np.r_[0, np.cumsum(table.of(flat) != np.frombuffer(b"".join(b" " + x for x, good in zip(raw, ok) if good), np.uint8))]
    at = np.cumsum(size[ok])
    ok[ok] = np.diff(np.r_[0, differ[at]]) == 0
    return ok


class Groups:
    """The aligned tokens of several texts laid end to end.

    ``a``, ``b``: ids; ``a_end``, ``b_end``: byte ends; ``cuts``: byte ends of the texts.
    """

    def __init__(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, cuts: np.ndarray):
        end = np.concatenate([a_end, b_end])
        start = np.concatenate([np.r_[0, a_end[:-1]][:len(a)], np.r_[0, b_end[:-1]][:len(b)]])
        kind = np.r_[np.zeros(len(a), np.int8), np.ones(len(b), np.int8)]
        order = np.lexsort((kind, start))
        self.start, end, self.kind, self.id = start[order], end[order], kind[order], np.concatenate([a, b])[order]
        n, at = len(order), np.arange(len(order))
        top = np.maximum.accumulate(end) if n else end
        self.new = np.r_[np.ones(min(n, 1), bool), self.start[1:] >= top[:-1]]
        self.doc = np.searchsorted(cuts, self.start, "right")
        # the last token of the other kind before each token overlaps it if it ends beyond its start
        last = [np.maximum.accumulate(np.where(self.kind == k, at, -1)) if n else at for k in (0, 1)]
        other = np.where(self.kind == 0, last[1], last[0])
        hit = np.flatnonzero((other >= 0) & (end[other] > self.start)) if n else at
        mine, theirs = self.id[hit], self.id[other[hit]]
        first = self.kind[hit] == 0
        self.link_doc, self.link_a, self.link_b = self.doc[hit], np.where(first, mine, theirs), np.where(first, theirs, mine)

    def texts(self, names: list[str], a_size: int, b_size: int, docs: int) -> list[str]:
        """Per text its groups in writing; ``names`` are the ids of A and of B, each with a comma and then with its group's mark behind."""
        group = np.cumsum(self.new)
        order = np.argsort(group * 2 + self.kind, kind="stable")
        key = (group * 2 + self.kind)[order]
        closes = np.r_[key[1:] != key[:-1], np.ones(min(len(key), 1), bool)]
        size = a_size + b_size
        at = self.id[order] + np.where(self.kind[order] == 1, a_size, 0) + np.where(closes, size, 0)
        ends = np.searchsorted(self.doc, np.arange(docs), "right").tolist()
        words = list(map(names.__getitem__, at.tolist()))
        return ["".join(words[i:j])[:-1] for i, j in zip([0, *ends[:-1]], ends)]


class Aligner:
    def __init__(self, a_path: str, b_path: str, pattern: str | None = None):
        self.a, self.b = ByteLevel(a_path, pattern), Pieces(b_path)
        self.a_table, self.b_table = ByteTable(self.a.bytes), ByteTable(self.b.bytes)
        self.a_len, self.b_len = self.a_table.len, self.b_table.len
        ids = [str(i) for i in range(max(len(self.a_len), len(self.b_len)))]
        a, b = ids[:len(self.a_len)], ids[:len(self.b_len)]
        self.names = [x + "," for x in a + b] + [x + "|" for x in a] + [x + ";" for x in b]

    def align(self, raw: list[bytes]) -> dict[str, np.ndarray | list[str]]:
        """Per text its counts and digest, and its distinct linked pairs (``pair`` = A id * B ids + B id) with their multiplicity."""
        texts = [x.decode("utf-8", "replace") for x in raw]
        a_ids, b_ids = self.a.ids([" " + t for t in texts]), self.b.ids(texts)
        whole = covering(a_ids, self.a_table, raw) & covering(b_ids, self.b_table, raw)
        a_ids, b_ids = ([x if ok else x[:0] for x, ok in zip(ids, whole)] for ids in (a_ids, b_ids))
        n = len(raw)
        a, b = np.concatenate(a_ids).astype(np.int64), np.concatenate(b_ids).astype(np.int64)
        cuts = np.cumsum([len(x) + 1 if ok else 0 for x, ok in zip(raw, whole)])
        g = Groups(a, np.cumsum(self.a_len[a]), b, np.cumsum(self.b_len[b]), cuts)
        code = g.link_doc.astype(np.int64) * (len(self.a_len) * len(self.b_len)) + g.link_a * len(self.b_len) + g.link_b
        distinct, times = np.unique(code, return_counts=True)
        per = len(self.a_len) * len(self.b_len)
        written = g.texts(self.names, len(self.a_len), len(self.b_len), n)
        return {"n_a": np.array([len(x) for x in a_ids], np.int64), "n_b": np.array([len(x) for x in b_ids], np.int64),
                "n_groups": np.bincount(g.doc[g.new], minlength=n).astype(np.int64), "n_links": np.bincount(g.link_doc, minlength=n).astype(np.int64),
                "groups_sha256": [hashlib.sha256(w.encode()).hexdigest() if ok else "" for w, ok in zip(written, whole)],
                "n_pairs": np.bincount((distinct // per).astype(np.int64), minlength=n).astype(np.int64), "pair": distinct % per, "times": times}


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str, pattern: str | None) -> Aligner:
    return Aligner(a_path, b_path, pattern)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_pairs")
_SLICE_SCHEMA = ("slice long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_pairs array<long>, "
                 "groups_sha256 array<string>, at binary, times binary, pair array<long>, n array<long>")


def _slices(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, pattern: str | None, most: int) -> Iterator[pa.RecordBatch]:
    aligner, number = _aligner(a_path, b_path, pattern), slice_ids()

    def flush():
        pair, at = np.unique(np.concatenate([g["pair"] for g in held]), return_inverse=True)
        row = [pa.array([next(number)]), listed(pa.concat_arrays(ids)), *[listed(pa.array(np.concatenate([g[c] for g in held]))) for c in _COUNTS],
               listed(pa.array([x for g in held for x in g["groups_sha256"]], pa.string())),
               pa.array([packed(at)], pa.binary()), pa.array([packed(np.concatenate([g["times"] for g in held]))], pa.binary()),
               listed(pa.array(pair)), listed(pa.array(np.bincount(at, minlength=len(pair)).astype(np.int64)))]
        return pa.RecordBatch.from_arrays(row, ["slice", "doc_id", *_COUNTS, "groups_sha256", "at", "times", "pair", "n"])

    ids, held, size = [], [], 0
    for batch in batches:
        for i, j, off, data in text_slices(batch):
            raw, cut = data.tobytes(), off.tolist()
            held.append(aligner.align([raw[x:y] for x, y in zip(cut[:-1], cut[1:])]))
            ids.append(batch.column(0).slice(i, j - i))
            size += len(raw) + 64 * (j - i)
            if size >= most:
                yield flush()
                ids, held, size = [], [], 0
    if held:
        yield flush()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the answered slices."""
    for batch in batches:
        for r in range(batch.num_rows):
            col = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
            at, times = unpacked(col["at"].as_py()), unpacked(col["times"].as_py()).astype(np.int64)
            count = np.zeros(0, np.int64) if not col["count"].is_valid else col["count"].values.to_numpy(zero_copy_only=False).astype(np.int64)
            best = np.zeros(0, np.int64) if not col["best"].is_valid else col["best"].values.to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(col["n_pairs"].values.to_numpy(zero_copy_only=False))

            def total(x):
                return np.diff(np.r_[0, np.r_[0, np.cumsum(x * times)][ends]])

            yield pa.RecordBatch.from_arrays(
                [col["doc_id"].values, *[col[c].values for c in _COUNTS[:-1]], pa.array(total(best[at])), pa.array(total(count[at])), col["groups_sha256"].values],
                ["doc_id", *_COUNTS[:-1], "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """Slices of documents with their tokens' groups counted and their distinct links, as a written table.

    ``pattern``: how A splits a text into pieces; given, repeated pieces are encoded once.
    """
    prepare(docs.sparkSession)
    src = as_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")
    return cut_lineage(src.mapInArrow(lambda it: _slices(it, a_path, b_path, pattern, slice_bytes), _SLICE_SCHEMA))


def pair_counts(slices: DataFrame, b_ids: int) -> DataFrame:
    """``key`` (pair), ``count`` (documents that hold it linked) and ``best`` (1: its A id's highest count)."""
    counts = slices.select(F.inline(F.arrays_zip("pair", "n"))).groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("a", (F.col("pair") / b_ids).cast("int"))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select(F.col("pair").alias("key"), "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def report(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """Per row: tokens of A and B, groups, links, links that are their A id's best, corpus counts summed, and a digest of the groups."""
    slices = align(docs, a_path, b_path, pattern, slice_bytes)
    import sentencepiece
    b_ids = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    got = with_answers(slices, "pair", pair_counts(slices, b_ids), "count", "best").drop("pair", "n")
    return got.mapInArrow(_rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
