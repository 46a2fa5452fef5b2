"""Column profiling.

Wide tables are profiled in few passes: null counts and moments for every
column come from one aggregation; value counts for many columns come from one
unpivot + partial ``groupBy(column, value)``; top-k lists use
``orderBy().limit()`` (TakeOrderedAndProject keeps k rows per task).  Only
per-column summaries (a handful of numbers per column) reach the driver.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from .clean import exact_quantiles
from ..session import cut_lineage
from .columns import displayable_columns

DESCRIBE_SCHEMA = ("column string, count bigint, mean double, std double, min double, "
                   "q25 double, q50 double, q75 double, max double")


def null_counts(df: DataFrame) -> DataFrame:
    """A1: (position, column, nulls) for every column, from one aggregation."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls"))
        for i, c in enumerate(df.columns)])).alias("s")).select("s.*")


def total_nulls(before: DataFrame, after: DataFrame) -> DataFrame:
    """A2: total NULL cells before and after cleaning (one row)."""
    def total(df):
        return null_counts(df).agg(F.coalesce(F.sum("nulls"), F.lit(0)).cast("bigint").alias("t"))
    both = total(before).select(F.lit(0).alias("k"), "t").unionByName(
        total(after).select(F.lit(1).alias("k"), "t"))
    return both.agg(F.max(F.when(F.col("k") == 0, F.col("t"))).alias("nulls_before"),
                    F.max(F.when(F.col("k") == 1, F.col("t"))).alias("nulls_after"))


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A3: count, mean, sample std, min, exact 25/50/75 % (linear), max per numeric column."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not cols:
        return df.sparkSession.createDataFrame([], DESCRIBE_SCHEMA)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.approx_count_distinct(x).alias(f"d{i}")]
    mom = df.agg(*aggs).first()                       # one row: 6 numbers per column
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75], {c: mom[f"n{i}"] for i, c in enumerate(cols)},
                         distinct={c: mom[f"d{i}"] for i, c in enumerate(cols)})
    rows = [(c, mom[f"n{i}"], mom[f"m{i}"], mom[f"s{i}"], mom[f"lo{i}"], *qs[c], mom[f"hi{i}"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, DESCRIBE_SCHEMA)


def _unpivot_text(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())


def distinct_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A4: distinct non-NULL values per column (unpivot, dedupe, count; all partial)."""
    cols = list(cols if cols is not None else df.columns)
    return _unpivot_text(df, cols).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A5: (value, count) over the non-NULL values of ``col``."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).count()


def top_values(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values; ties broken by value."""
    return value_counts(df, col).orderBy(F.desc("count"), F.asc("value")).limit(n)


def _min_max(df: DataFrame, cols: list[str]) -> dict[str, tuple[float | None, float | None]]:
    row = df.agg(*[e for i, c in enumerate(cols) for e in
                   (F.min(F.col(c).cast("double")).alias(f"a{i}"),
                    F.max(F.col(c).cast("double")).alias(f"b{i}"))]).first()
    return {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}


def bucket_expr(c, lo: float, hi: float, bins: int):
    """Equal-width bucket 0..bins-1 of ``c`` on [lo, hi]; the maximum joins the last bucket."""
    if hi == lo:
        return F.lit(0)
    b = F.floor((F.col(c).cast("double") - F.lit(lo)) / (F.lit(hi) - F.lit(lo)) * F.lit(bins))
    return F.least(F.lit(bins - 1), b).cast("int")


def _with_empty(counts: DataFrame, grid: DataFrame, first: int, last: int) -> DataFrame:
    """``counts`` of the buckets from ``first`` to ``last``, 0 for those of ``grid`` without rows."""
    return (counts.where(F.col("bucket").between(first, last)).unionByName(grid.withColumn("count", F.lit(0).cast("bigint")))
                  .groupBy("bucket").agg(F.sum("count").alias("count")))


def histogram(df: DataFrame, col: str, bins: int = 25) -> DataFrame:
    """Exactly ``bins`` equal-width buckets (empty ones included)."""
    lo, hi = _min_max(df, [col])[col]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bucket int, lower double, upper double, count bigint")
    counts = (df.where(F.col(col).isNotNull()).groupBy(bucket_expr(col, lo, hi, bins).alias("bucket"))
                .agg(F.count(F.lit(1)).alias("count")))
    width = (F.lit(hi) - F.lit(lo)) / F.lit(bins)
    return (_with_empty(counts, spark.range(bins).select(F.col("id").cast("int").alias("bucket")), 0, bins - 1)
                .select("bucket", (F.lit(lo) + F.col("bucket") * width).alias("lower"),
                        (F.lit(lo) + (F.col("bucket") + 1) * width).alias("upper"),
                        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def nice_width(lo: float, hi: float, most: int) -> float:
    """The least width of 1, 2 or 5 times a power of ten whose multiples cut [lo, hi] into at most ``most`` buckets.

    Values on both sides of zero never share a bucket, so two are always allowed.
    """
    if hi <= lo:
        return 1.0
    most = max(2, most)
    power = math.floor(math.log10((hi - lo) / most)) - 1
    while True:
        for m in (1, 2, 5):
            width = float(f"{m}e{power}")
            if math.floor(hi / width) - math.floor(lo / width) + 1 <= most:
                return width
        power += 1


def auto_histogram(df: DataFrame, col: str, most: int = 25) -> DataFrame:
    """A7 with automatic bins: at most ``most`` buckets [k w, (k + 1) w) of a round width w (empty ones included).

    A constant column has one bucket of width 1; nulls are not counted; without a value there is no bucket.
    """
    lo, hi = _min_max(df, [col])[col]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bucket bigint, lower double, upper double, count bigint")
    width = nice_width(lo, hi, most)
    first, last = math.floor(lo / width), math.floor(hi / width)
    bucket = F.floor(F.col(col).cast("double") / F.lit(width))
    counts = df.where(F.col(col).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    return _with_empty(counts, spark.range(first, last + 1).withColumnRenamed("id", "bucket"), first, last).select(
        "bucket", (F.col("bucket") * F.lit(width)).alias("lower"), ((F.col("bucket") + 1) * F.lit(width)).alias("upper"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


#: Bandwidths beyond which a kernel adds nothing that a double of the sum shows.
REACH = 9.0


def density(df: DataFrame, col: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Exact Gaussian KDE (Scott bandwidth ``std * n^-1/5``) on a regular grid.

    Rows are first collapsed to (value, count), so the kernel sum runs once per
    distinct value, and only for the grid points within ``REACH`` bandwidths of
    it (beyond, the kernel is under 1e-17); a partial ``groupBy(point)`` folds
    the contributions before the shuffle.  The grid spans ``cut`` bandwidths
    beyond the data range.
    """
    x = F.col(col).cast("double")
    st = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("s"), F.min(x).alias("lo"),
                F.max(x).alias("hi")).first()
    spark = df.sparkSession
    schema = "point int, x double, density double"
    if not st["n"] or st["n"] < 2 or not st["s"]:
        return spark.createDataFrame([], schema)
    n, h = st["n"], st["s"] * st["n"] ** (-1.0 / 5.0)
    start, stop = st["lo"] - cut * h, st["hi"] + cut * h
    step = (stop - start) / (points - 1)
    norm = 1.0 / (n * h * math.sqrt(2.0 * math.pi))
    distinct = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("w"))
    grid_x = F.lit(start) + F.col("point") * F.lit(step)
    near = [F.greatest(F.lit(0), F.ceil((F.col("v") - F.lit(REACH * h) - F.lit(start)) / F.lit(step)).cast("int")),
            F.least(F.lit(points - 1), F.floor((F.col("v") + F.lit(REACH * h) - F.lit(start)) / F.lit(step)).cast("int"))]
    contrib = (distinct.withColumns({"a": near[0], "b": near[1]}).where("a <= b")
                       .select("v", "w", F.explode(F.sequence("a", "b")).alias("point"))
                       .select("point", (F.col("w") * F.exp(-0.5 * F.pow((grid_x - F.col("v")) / F.lit(h), 2)))
                               .alias("k")))
    sums = contrib.groupBy("point").agg(F.sum("k").alias("k"))
    grid = spark.range(points).select(F.col("id").cast("int").alias("point"))
    return grid.join(sums, "point", "left").select(
        "point", grid_x.alias("x"), (F.coalesce("k", F.lit(0.0)) * F.lit(norm)).alias("density"))


# HLL estimates under this are counted exactly.  The question is "more than 10?":
# with a relative error of 5 % an estimate of 100 is 18 standard errors away.
EXACT_BELOW = 100


def few_distinct(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Distinct counts that are exact wherever they matter for a <= 10 test.

    One pass of HLL estimates (bounded state per column); only the columns
    estimated under ``EXACT_BELOW`` are counted exactly, and those have few
    values, so no high-cardinality column is ever shuffled for this.  An
    estimate >= 100 (5 % relative error) certainly means more than 10 values.
    """
    if not cols:
        return {}
    est = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"e{i}") for i, c in enumerate(cols)]).first()
    low = [c for i, c in enumerate(cols) if est[f"e{i}"] < EXACT_BELOW]
    out = {c: est[f"e{i}"] for i, c in enumerate(cols)}
    if low:
        exact = {r["column"]: r["n_distinct"] for r in distinct_counts(df, low).collect()}
        out.update({c: exact.get(c, 0) for c in low})
    return out


def profile_kinds(df: DataFrame, cols: list[str] | None = None) -> dict[str, str]:
    """Chart kind per displayable column (A17's dispatcher)."""
    cols = cols if cols is not None else displayable_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    nd = few_distinct(df, cols)
    kinds = {}
    for c in cols:
        t, u = types[c], nd.get(c, 0)
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) or "date" in c.lower():
            kinds[c] = "date"
        elif isinstance(t, T.NumericType) and u > 10:
            kinds[c] = "histogram"
        elif u <= 10:
            kinds[c] = "counts"
        elif c in K.CLOCK_COLUMNS:
            kinds[c] = "clock"
        else:
            kinds[c] = "top"
    return kinds


def profile(df: DataFrame, bins: int = 25, top: int = 20) -> DataFrame:
    """One long table ``(column, kind, value, bucket, count)`` for every chart.

    date / counts / clock: all value counts; top: the ``top`` most frequent
    values; histogram: non-empty equal-width buckets of ``bins``.
    """
    kinds = profile_kinds(df)
    parts = []
    listed = [c for c, k in kinds.items() if k in ("date", "counts", "clock", "top")]
    if listed:
        counted = _unpivot_text(df, listed).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
        if any(kinds[c] == "top" for c in listed):
            counted = cut_lineage(counted)         # read once for all columns, not once per top list
        full = [c for c in listed if kinds[c] != "top"]
        if full:
            parts.append(counted.where(F.col("column").isin(full)))
        for c in listed:
            if kinds[c] == "top":
                parts.append(counted.where(F.col("column") == c)
                             .orderBy(F.desc("count"), F.asc("value")).limit(top))
    listed_df = None
    for p in parts:
        p = p.select("column", F.lit(None).cast("string").alias("kind"), "value",
                     F.lit(None).cast("int").alias("bucket"), F.col("count"))
        listed_df = p if listed_df is None else listed_df.unionByName(p)
    hist = [c for c, k in kinds.items() if k == "histogram"]
    out = listed_df
    if hist:
        mm = _min_max(df, hist)
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(),
                                                      bucket_expr(c, *mm[c], bins)).alias("bucket"))
            for c in hist])).alias("h")).select("h.*").where(F.col("bucket").isNotNull())
        hp = long.groupBy("column", "bucket").agg(F.count(F.lit(1)).alias("count")).select(
            "column", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"),
            "bucket", "count")
        out = hp if out is None else out.unionByName(hp)
    if out is None:
        return df.sparkSession.createDataFrame([], "column string, kind string, value string, "
                                                   "bucket int, count bigint")
    kind_map = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return out.withColumn("kind", F.element_at(kind_map, F.col("column")))


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
