"""Row lookups and index-aligned joins.

All are equi-joins.  Whether a side is broadcast is left to Spark, which
compares its size in bytes with ``autoBroadcastJoinThreshold`` when it plans
and again, measured, when it runs.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_rows(keys: DataFrame, df: DataFrame, cols: Iterable[str], id_col: str = "id") -> DataFrame:
    """Values of ``cols`` for the rows whose id is in ``keys`` (inner equi-join)."""
    return keys.select(id_col).join(df.select(id_col, *cols), id_col, "inner")


def aligned_mask(features: DataFrame, labels: DataFrame, predicate, id_col: str = "id") -> DataFrame:
    """Feature rows whose label (in another frame) satisfies ``predicate`` (semi-join)."""
    return features.join(labels.where(predicate).select(id_col), id_col, "left_semi")


def lookup(df: DataFrame, col: str, table: DataFrame, key: str, value: str, out: str | None = None,
           keep_unmatched: bool = True) -> DataFrame:
    """Dictionary lookup of ``col`` in ``table``; unmatched keep their own value."""
    out = out or col
    t = table.select(F.col(key).alias("__k"), F.col(value).alias("__v")).dropDuplicates(["__k"])
    joined = df.join(t, F.col(col) == F.col("__k"), "left")
    res = F.coalesce(F.col("__v"), F.col(col)) if keep_unmatched else F.col("__v")
    cols = [res.alias(out) if c == out else F.col(c) for c in df.columns]
    if out not in df.columns:
        cols.append(res.alias(out))
    return joined.select(*cols)
