"""Vectorised word handling on Arrow batches, shared by the text operators.

Texts travel to Python as UTF-8 bytes in Arrow buffers; words, word hashes and
window hashes are numpy expressions over the whole buffer, so no Python code
runs per word.  Batches are cut into slices of half a megabyte of text, which
bounds a task's memory by the slice or by its longest single text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelens.session import ship_package

SLICE_BYTES = 1 << 19

#: ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, a-z and all non-ASCII bytes.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True
#: A-Z to a-z on bytes; bytes of longer UTF-8 sequences stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _powers(base: np.uint64, n: int, cache: dict = {}) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, grown on demand."""
    have = cache.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE_BYTES + 1024), base, np.uint64)
        full[0] = 1
        have = cache[base] = np.multiply.accumulate(full)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, offsets, bytes)`` of runs of rows of about ``most`` bytes of text.

    ``column`` is binary; a null text counts as empty.  Offsets start at 0.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null(b"")
    wide = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], wide, len(col) + 1, col.offset * np.dtype(wide).itemsize).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, off[i:j + 1] - off[i], data[off[i]:off[j]]
        i = j


class Words:
    """The words of several texts: byte spans, owner and hash of each."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, table: np.ndarray, lower: bool):
        if lower:
            data = LOWER[data]
        inside = table[data]
        edge = np.empty(len(data) + 1, bool)
        edge[1:] = ~inside if len(data) else False
        edge[0] = True
        edge[offsets] = True                      # a text's first byte begins a word, if it is of one
        self.start = np.flatnonzero(inside & edge[:-1])
        last = np.ones(len(data), bool)
        if len(data):
            last[:-1] = ~inside[1:]
            cut = offsets[1:] - 1
            last[cut[cut >= 0]] = True
        self.end = np.flatnonzero(inside & last) + 1
        #: word index of each text's first word, and the total at the end
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.first[-1] = len(self.start)
        self.count = np.diff(self.first)
        self.data, self._hash = data, None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            n = len(self.data)
            acc = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _powers(_P, n), out=acc[1:])
            h = (acc[self.end] - acc[self.start]) * _powers(_inverse(_P), n + 1)[self.start]
            self._hash = mix(h ^ (self.end - self.start).astype(np.uint64))
        return self._hash

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``size`` consecutive words, and whether it lies in one text."""
        n = max(0, len(self.start) - size + 1)
        return window_hash(self.hash, np.arange(n), np.arange(n) + size), self.owner()[:n] == self.owner()[size - 1:size - 1 + n]

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count), dtype=np.int32), self.count)


def window_hash(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the word sequences ``words[start:end]``, from one running sum."""
    acc = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_Q, len(words)), out=acc[1:])
    return mix((acc[end] - acc[start]) * _powers(_inverse(_Q), len(words) + 1)[start] ^ (end - start).astype(np.uint64))


def as_bytes(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns and the text as UTF-8 bytes; columns of clashing names are left behind."""
    return df.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias("text"))


def by_hash(share: float, *cols: str, seed: str) -> Column:
    """True for about ``share`` of the rows, chosen by a hash of ``cols``: every task filters its own rows."""
    m = 1_000_000_007
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(m)) < F.lit(int(min(1.0, share) * m))


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in the Python workers."""
    ship_package(spark)
    return spark
