"""Registry of named queries with their DuckDB oracles.

Each entry: a Spark builder ``(spark, sf_dir) -> DataFrame``, an optional
oracle SQL string and the result's double columns (rounded to 6 places on
both sides so engine-specific last-bit differences do not change the hash).
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sql import rounded


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: list[str] = field(default_factory=list)
    doc: str = ""


REGISTRY: dict[str, Entry] = {}


def binary_round(c, digits: int = 6):
    """Round like the oracle engine: half away from zero on the binary product
    ``x * 10^digits`` (Spark's ``round`` rounds the decimal string instead, so
    12.7920614999999 scales to exactly 12792061.5 and goes the other way)."""
    scale = float(10 ** digits)
    r = F.floor(F.abs(c) * F.lit(scale) + F.lit(0.5)).cast("double")
    signed = F.when(c < 0, -r).otherwise(r) / F.lit(scale)
    return F.when(F.abs(c) < F.lit(1e15), signed).otherwise(c)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[binary_round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def query(name: str, sql: str | None = None, doubles: list[str] | None = None):
    """Decorator registering ``fn(spark, sf_dir)`` under ``name``."""
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(name, build, sql, list(doubles or []), fn.__doc__ or "")
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: e.build for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: rounded(e.sql, e.doubles) for k, e in REGISTRY.items() if e.sql}
