"""Documents in slices, each with the distinct keys (words, pairs of tokens) that occur in it.

What the corpus knows of a key is needed wherever the key occurs.  Shuffling every
occurrence would move many times the text and put the commonest key into one task.
A slice (some megabytes of text) asks for each of its distinct keys once instead:
a key that occurs everywhere is asked for once a slice, and the answers come back as
arrays in the order of the slice's keys.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_ids():
    """Numbers for the slices of this task, different from those of all other tasks of the job."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def packed(values: np.ndarray) -> bytes:
    """Little-endian unsigned integers in two bytes each if they fit, else in three (all third bytes last) or four; the first byte says which."""
    top = int(values.max()) if len(values) else 0
    if top < 1 << 16:
        return b"\2" + values.astype("<u2").tobytes()
    if top < 1 << 24:
        return b"\3" + (values & 0xFFFF).astype("<u2").tobytes() + (values >> 16).astype(np.uint8).tobytes()
    return b"\4" + values.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[:1] != b"\3":
        return np.frombuffer(data, "<u2" if data[:1] == b"\2" else "<u4", offset=1)
    n = (len(data) - 1) // 3
    return np.frombuffer(data, "<u2", n, 1) + (np.frombuffer(data, np.uint8, n, 1 + 2 * n).astype(np.uint32) << 16)


def listed(values: pa.Array) -> pa.ListArray:
    """One list that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def with_answers(slices: DataFrame, keys: str, table: DataFrame, *values: str) -> DataFrame:
    """``slices`` and, per value column of ``table`` (key, values), an array aligned with the array column ``keys``.

    Keys that the table lacks get null; a slice without keys gets null arrays.
    """
    asked = slices.select("slice", F.posexplode(keys).alias("at", "key"))
    got = (asked.join(table, "key", "left").groupBy("slice")
           .agg(F.sort_array(F.collect_list(F.struct("at", *values))).alias("got")))
    return slices.join(got.select("slice", *[F.col(f"got.{v}").alias(v) for v in values]), "slice", "left")
