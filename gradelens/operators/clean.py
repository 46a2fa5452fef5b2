"""Cleaning (A9-A11, C1): drop empty columns, median for numbers, mode for text.

Scale notes
-----------
* Null counts for every column come from ONE aggregation (one scan).
* Modes: the text columns are unpivoted into (column, value) pairs and
  counted with a partial (map-side combined) ``groupBy``; a hot value
  collapses to one row per partition before the shuffle.  The winner per
  column is a ``min_by`` over that small table, also partial.
* Medians are exact but never gather a column into one task: ``exact_medians``
  narrows a value bracket around the middle rank with bounded-memory
  ``percentile_approx`` summaries and counting passes, and only collects the
  distinct (value, count) pairs of a bracket once it holds at most
  ``collect_cap`` rows.  Hot values are handled by excluding a bracket end
  once it is known not to hold the rank.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import columns_by_type

COLLECT_CAP = 50_000
GK_ACCURACY = 10_000


def null_and_value_counts(df: DataFrame, cols: list[str] | None = None) -> dict[str, tuple[int, int]]:
    """{column: (nulls, non-nulls)} from one aggregation."""
    return {c: v[:2] for c, v in column_counts(df, cols, distinct_of=()).items()}


def column_counts(df: DataFrame, cols: list[str] | None = None,
                  distinct_of=None) -> dict[str, tuple[int, int, int | None]]:
    """{column: (nulls, non-nulls, approximate distinct or None)} from ONE aggregation.

    ``distinct_of`` lists the columns that also get an HLL distinct estimate
    (default: the numeric ones, which may need a median)."""
    cols = list(cols if cols is not None else df.columns)
    if not cols:
        return {}
    if distinct_of is None:
        distinct_of = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    aggs = [F.count(F.col(c)).alias(f"v{i}") for i, c in enumerate(cols)]
    aggs += [F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols) if c in distinct_of]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    n = row["n"]
    return {c: (n - row[f"v{i}"], row[f"v{i}"], row[f"d{i}"] if c in distinct_of else None)
            for i, c in enumerate(cols)}


def all_null_columns(df: DataFrame, counts: dict | None = None) -> list[str]:
    """A11 helper: columns with no value (a 0-row table keeps its columns)."""
    counts = counts or null_and_value_counts(df)
    return [c for c, (nulls, vals) in counts.items() if vals == 0 and nulls > 0]


# ---------------------------------------------------------------- medians ---

@dataclass
class _Target:
    col: str
    rank: int                 # 0-based rank among the column's non-NULL values
    below: int = 0            # values strictly under the bracket
    n_in: int = 0             # values inside the bracket
    lo: float | None = None   # bracket bounds; None = unbounded
    lo_incl: bool = True
    hi: float | None = None
    hi_incl: bool = True
    value: float | None = None
    done: bool = False

    def inside(self, c):
        cond = c.isNotNull()
        if self.lo is not None:
            cond = cond & ((c >= F.lit(self.lo)) if self.lo_incl else (c > F.lit(self.lo)))
        if self.hi is not None:
            cond = cond & ((c <= F.lit(self.hi)) if self.hi_incl else (c < F.lit(self.hi)))
        return cond


def _resolve_small(df: DataFrame, targets: list[_Target]) -> None:
    """Collect (value, count) pairs of small brackets and pick the ranks.

    Targets sharing a column and bracket (e.g. the two middle ranks, or all
    quartiles of a small column) are served by one cell of the unpivot.
    """
    brackets: dict[tuple, list[_Target]] = {}
    for t in targets:
        brackets.setdefault((t.col, t.lo, t.lo_incl, t.hi, t.hi_incl, t.below), []).append(t)
    keys = list(brackets)
    cells = [F.when(brackets[k][0].inside(F.col(k[0]).cast("double")),
                    F.struct(F.lit(i).alias("t"), F.col(k[0]).cast("double").alias("v")))
             for i, k in enumerate(keys)]
    pairs = (df.select(F.explode(F.array(*cells)).alias("p")).where(F.col("p").isNotNull())
               .select("p.t", "p.v").groupBy("t", "v").count())
    # Bounded: the brackets of a round hold at most collect_cap pairs together; Arrow transfer.
    table = pairs.toPandas()
    for i, k in enumerate(keys):
        part = table[table["t"] == i].sort_values("v")
        values, cum = part["v"].to_numpy(), part["count"].to_numpy().cumsum()
        for t in brackets[k]:
            pos = int(np.searchsorted(cum, t.rank - t.below, side="right"))
            if pos >= len(values):
                raise RuntimeError(f"quantile bracket lost rank {t.rank} of {t.col}")
            t.value, t.done = float(values[pos]), True


def _narrow(df: DataFrame, targets: list[_Target], accuracy: int) -> None:
    """One narrowing round for large brackets: approximate ends, then exact counts."""
    probes = []
    for t in targets:
        rel = t.rank - t.below
        margin = 2.0 / accuracy
        p1 = min(1.0, max(0.0, rel / t.n_in - margin))
        p2 = min(1.0, max(0.0, (rel + 1) / t.n_in + margin))
        probes.append(F.percentile_approx(F.when(t.inside(F.col(t.col).cast("double")),
                                                 F.col(t.col).cast("double")),
                                          [p1, p2], accuracy))
    ends = df.agg(*[p.alias(f"e{i}") for i, p in enumerate(probes)]).first()
    counts = []
    for i, t in enumerate(targets):
        a, b = ends[f"e{i}"]
        c = F.col(t.col).cast("double")
        inb = t.inside(c)
        counts += [F.count_if(inb & (c < a)).alias(f"lta{i}"), F.count_if(inb & (c <= a)).alias(f"lea{i}"),
                   F.count_if(inb & (c < b)).alias(f"ltb{i}"), F.count_if(inb & (c <= b)).alias(f"leb{i}")]
    row = df.agg(*counts).first()
    for i, t in enumerate(targets):
        a, b = ends[f"e{i}"]
        lta, lea, ltb, leb = (row[f"{k}{i}"] for k in ("lta", "lea", "ltb", "leb"))
        rel = t.rank - t.below
        if rel < lta:                      # approximate end overshot: keep the part below a
            t.hi, t.hi_incl, t.n_in = a, False, lta
        elif rel < lea:
            t.value, t.done = a, True
        elif rel < ltb:
            t.lo, t.lo_incl, t.hi, t.hi_incl = a, False, b, False
            t.below, t.n_in = t.below + lea, ltb - lea
        elif rel < leb:
            t.value, t.done = b, True
        else:
            t.lo, t.lo_incl = b, False
            t.below, t.n_in = t.below + leb, t.n_in - leb


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float],
                    nonnull: dict[str, int] | None = None, collect_cap: int = COLLECT_CAP,
                    accuracy: int = GK_ACCURACY,
                    distinct: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles (pandas/numpy 'linear' rule).

    For ``n`` values, quantile ``q`` sits at position ``(n-1)*q`` between the
    sorted values ``lo`` and ``hi`` and equals ``lo*(1-d) + hi*d``.  Only the
    needed ranks are located, with the distributed bracketing described in
    the module docstring: no task holds more than a bounded summary or
    ``collect_cap`` rows of a column.  ``distinct`` (approximate distinct
    counts, e.g. from ``approx_count_distinct`` in an earlier pass) lets
    low-cardinality columns skip the bracketing: their (value, count) table
    is small whatever the row count.
    """
    if not cols:
        return {}
    if nonnull is None:
        nonnull = {c: v for c, (_, v) in null_and_value_counts(df, cols).items()}
    targets: dict[tuple[str, int], _Target] = {}
    for c in cols:
        n = nonnull[c]
        for q in qs:
            if n == 0:
                continue
            pos = (n - 1) * q
            for r in {int(pos // 1), min(n - 1, int(-(-pos // 1)))}:
                targets.setdefault((c, r), _Target(col=c, rank=r, n_in=n))
    pending_all = list(targets.values())
    few = {c: 2 * k for c, k in (distinct or {}).items() if k is not None and k <= collect_cap // 2}
    while pending := [t for t in pending_all if not t.done]:
        # Brackets are collected together, at most collect_cap pairs in one round;
        # the rest wait for the next round or are narrowed further.
        small, large, room, taken = [], [], collect_cap, set()
        for t in sorted(pending, key=lambda t: min(t.n_in, few.get(t.col, t.n_in))):
            cost = min(t.n_in, few.get(t.col, t.n_in)) if t.lo is None and t.hi is None else t.n_in
            bracket = (t.col, t.lo, t.hi, t.below)
            if bracket in taken or cost <= room:
                room -= 0 if bracket in taken else cost
                taken.add(bracket)
                small.append(t)
            elif cost > collect_cap:
                large.append(t)
        if small:
            _resolve_small(df, small)
        if large:
            _narrow(df, large, accuracy)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = nonnull[c]
        vals: list[float | None] = []
        for q in qs:
            if n == 0:
                vals.append(None)
                continue
            pos = (n - 1) * q
            lo_r, hi_r = int(pos // 1), min(n - 1, int(-(-pos // 1)))
            lo, hi = targets[(c, lo_r)].value, targets[(c, hi_r)].value
            d = pos - lo_r
            vals.append(lo if lo_r == hi_r else lo * (1.0 - d) + hi * d)
        out[c] = vals
    return out


def exact_medians(df: DataFrame, cols: list[str], nonnull: dict[str, int] | None = None,
                  collect_cap: int = COLLECT_CAP, accuracy: int = GK_ACCURACY) -> dict[str, float | None]:
    """Exact median (mean of the two middle values) of each column."""
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5], nonnull, collect_cap, accuracy).items()}


# ------------------------------------------------------------------ modes ---

def column_modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """A10: most frequent non-NULL value per column, smallest value on ties."""
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())
    counted = pairs.groupBy("column", "value").count()
    best = counted.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("count")).alias("k"), F.col("value").alias("v"))).alias("mode"))
    found = {r["column"]: r["mode"] for r in best.collect()}   # one row per column
    return {c: found.get(c) for c in cols}


# ------------------------------------------------------------------ clean ---

@dataclass
class CleanModel:
    """Fitted cleaning: reusable on new batches and on streams."""
    dropped: list[str] = field(default_factory=list)
    numeric_fill: dict[str, float] = field(default_factory=dict)
    text_fill: dict[str, str] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        df = df.drop(*[c for c in self.dropped if c in df.columns])
        out = []
        for f in df.schema.fields:
            c = F.col(f.name)
            if f.name in self.numeric_fill and self.numeric_fill[f.name] is not None:
                dtype = "double" if isinstance(f.dataType, T.NumericType) else f.dataType
                c = F.coalesce(c.cast(dtype), F.lit(self.numeric_fill[f.name]))
            elif f.name in self.text_fill:
                c = F.coalesce(c, F.lit(self.text_fill[f.name]))
            out.append(c.alias(f.name))
        return df.select(*out)


def fit_clean(df: DataFrame, only_missing: bool = True) -> CleanModel:
    """Fit C1: which columns to drop and the median/mode fill values.

    With ``only_missing`` (the reference's behaviour) only columns that have
    a NULL in ``df`` get a fill value; ``False`` fits every column, for use on
    later batches or streams.
    """
    stats = column_counts(df)
    counts = {c: v[:2] for c, v in stats.items()}
    dropped = all_null_columns(df, counts)
    kept = df.drop(*dropped)
    num, txt = columns_by_type(kept)
    need = (lambda c: counts[c][0] > 0) if only_missing else (lambda c: True)
    num = [c for c in num if need(c)]
    txt = [c for c in txt if need(c)]
    medians = {c: v[0] for c, v in exact_quantiles(kept, num, [0.5], {c: counts[c][1] for c in num},
                                                    distinct={c: stats[c][2] for c in num}).items()}
    modes = column_modes(kept, txt)
    return CleanModel(dropped=dropped, numeric_fill=medians,
                      text_fill={c: (m if m is not None else "") for c, m in modes.items()})


def clean(df: DataFrame | None) -> DataFrame | None:
    """Drop 100 %-NULL columns, fill numbers with the median, text with the mode."""
    if df is None:
        return None
    return fit_clean(df).transform(df)
