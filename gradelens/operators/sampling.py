"""Deterministic split and folds (M1, W3): by a hash alone, or exact in size by the rank of the hash.

Membership is a function of (seed, id) only: the first 32 bits of
md5('<seed>:<id>') compared with the fraction, so the split is the same
whatever the partitioning, the executor count or a task retry, and needs no
shuffle, sort or ``rand()``.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K

TWO_32 = float(1 << 32)


def hash32(id_col: str, seed_text: str) -> Column:
    """Unsigned 32-bit hash: first 8 hex digits of md5(seed_text || id)."""
    digest = F.md5(F.concat(F.lit(seed_text), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def is_test(id_col: str = "id", test_fraction: float = K.SPLIT_TEST_FRACTION, seed: int = K.SEED) -> Column:
    return hash32(id_col, f"{seed}:").cast("double") < F.lit(test_fraction * TWO_32)


def least_hashes(df: DataFrame, id_col: str, k: int, seed_text: str) -> Column:
    """A condition that holds for the ``k`` rows with the least (hash, id).

    The k-th hash is found by counting: rows per upper half of the hash, then per lower
    half inside the bracket that the k-th falls in (65,536 counts each, combined before the
    shuffle), then per id among those of that very hash.  Nothing is sorted, and the
    condition is a comparison, the same whatever the partitioning.  Rows that share an id
    fall on the same side, so where ids repeat the k-th's id may take some rows more.  Rows
    without an id are never among them.
    """
    h = hash32(id_col, seed_text)
    if k <= 0:
        return F.lit(False)

    def bracket(rows: DataFrame, key: Column, before: int) -> tuple[int | None, int]:
        for r in sorted(rows.groupBy(key.alias("b")).count().collect(), key=lambda r: r["b"]):
            if before + r["count"] >= k:
                return r["b"], before
            before += r["count"]
        return None, before

    known = df.where(F.col(id_col).isNotNull()).select(id_col, h.alias("__h"))
    high, before = bracket(known, F.shiftright("__h", 16), 0)
    if high is None:                                       # fewer than k rows have an id
        return F.col(id_col).isNotNull()
    known = known.where(F.shiftright("__h", 16) == high)
    low, before = bracket(known, F.col("__h").bitwiseAND(0xFFFF), before)
    value = high * 65536 + low
    last, _ = bracket(known.where(F.col("__h") == value), F.col(id_col), before)
    return F.coalesce((h < value) | ((h == value) & (F.col(id_col) <= F.lit(last))), F.lit(False))


def exact_test(df: DataFrame, id_col: str = "id", test_fraction: float = K.SPLIT_TEST_FRACTION, seed: int = K.SEED) -> Column:
    """M1 exact: the condition of the ``ceil(test_fraction * n)`` test rows."""
    return least_hashes(df, id_col, math.ceil(test_fraction * df.count()), f"{seed}:")


def train_test_split(df: DataFrame, id_col: str = "id", test_fraction: float = K.SPLIT_TEST_FRACTION,
                     seed: int = K.SEED, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """M1: (train, test); about ``test_fraction`` of rows go to test, ``exact``: rounded up to a whole row."""
    t = exact_test(df, id_col, test_fraction, seed) if exact else is_test(id_col, test_fraction, seed)
    return df.where(~t), df.where(t)


def with_split(df: DataFrame, id_col: str = "id", test_fraction: float = K.SPLIT_TEST_FRACTION,
               seed: int = K.SEED, col: str = "is_test", exact: bool = False) -> DataFrame:
    return df.withColumn(col, exact_test(df, id_col, test_fraction, seed) if exact else is_test(id_col, test_fraction, seed))


def fold_of(id_col: str = "id", k: int = K.CV_FOLDS, seed: int = K.SEED) -> Column:
    """Fold 0..k-1 from an independent hash of the id."""
    return (hash32(id_col, f"{seed}:fold:") % F.lit(k)).cast("int")


def with_folds(df: DataFrame, id_col: str = "id", k: int = K.CV_FOLDS, seed: int = K.SEED,
               col: str = "fold") -> DataFrame:
    return df.withColumn(col, fold_of(id_col, k, seed))


#: Rows of a rank bucket, about.
BUCKET_ROWS = 10_000


def with_stratified_folds(df: DataFrame, strata: list[str], id_col: str = "id", k: int = K.CV_FOLDS, seed: int = K.SEED,
                          col: str = "fold", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """W3 stratified: folds 0..k-1 whose sizes differ by one at most within every stratum.

    A row's place in its stratum is its rank by (hash, id): the rows of the buckets
    of the hash before its own, which are counted and joined back, and its rank inside the
    bucket.  So no task sorts a stratum, only a bucket of about ``bucket_rows`` rows.
    The first ``n % k`` folds get the rows over, as SQL's ``ntile`` does.  Nulls form a stratum of
    their own; rows without an id come first in theirs; rows that share an id are
    ranked in any order.
    """
    bits = min(32, max(0, math.ceil(math.log2(max(1, df.count() / bucket_rows)))))
    h = F.coalesce(hash32(id_col, f"{seed}:fold:"), F.lit(0))
    rows = df.withColumn("__h", h).withColumn("__b", F.shiftright("__h", 32 - bits))
    keys = [f"__s{i}" for i in range(len(strata))]
    rows = rows.select("*", *[F.struct(F.col(c)).alias(x) for c, x in zip(strata, keys)])      # a struct of null is no null: it joins
    counts = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "__b", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy(*keys)).alias("__n"))
    ranked = rows.join(counts, [*keys, "__b"])
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", id_col)) - 1
    small = F.floor(F.col("__n") / k)
    longer = (F.col("__n") % k) * (small + 1)               # rows in the folds that have one more
    fold = F.when(place < longer, F.floor(place / (small + 1))).otherwise(F.col("__n") % k + F.floor((place - longer) / F.greatest(small, F.lit(1))))
    return ranked.withColumn(col, fold.cast("int")).drop("__h", "__b", "__before", "__n", *keys)
