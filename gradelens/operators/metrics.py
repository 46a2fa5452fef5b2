"""Model metrics as single-pass aggregations.

Each metric is one algebraic aggregation over (label, prediction) pairs, so
it is computed partially per task and merged; nothing is collected row-wise.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, label: str, pred: str, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """(actual, predicted, count) for every label pair, zero cells included."""
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                      F.count_if((F.col(label) == a) & (F.col(pred) == p)).alias("count"))
             for a in labels for p in labels]
    return df.agg(F.array(*cells).alias("m")).select(F.explode("m").alias("c")).select("c.*")


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row (n, r2, mae, rmse); R² = 1 - SSE/SST (not squared correlation).

    SST is ``var_pop(label) * n`` (Spark merges variance buffers with a stable
    update), so no second pass over the data is needed.
    """
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    e = p - y
    agg = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("vp"))
    return agg.select(
        "n",
        (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("vp") * F.col("n"))).alias("r2"),
        F.col("mae"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def classification_metrics(df: DataFrame, label: str, pred: str, positive: int = 1) -> DataFrame:
    """One row (n, tp, fp, fn, tn, accuracy %, precision, recall, f1) of class ``positive``.

    Zero divisions give 0 (the reference's ``zero_division=0``).
    """
    y, p = F.col(label), F.col(pred)
    agg = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == positive) & (p == positive)).alias("tp"),
        F.count_if((y != positive) & (p == positive)).alias("fp"),
        F.count_if((y == positive) & (p != positive)).alias("fn"),
        F.count_if((y != positive) & (p != positive)).alias("tn"))
    zero = F.lit(0.0)
    return agg.select(
        "n", "tp", "fp", "fn", "tn",
        F.coalesce(F.try_divide((F.col("tp") + F.col("tn")) * F.lit(100.0), F.col("n")), zero).alias("accuracy"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), zero).alias("recall"),
        F.coalesce(F.try_divide(F.col("tp") * F.lit(2.0), F.col("tp") * 2 + F.col("fp") + F.col("fn")),
                   zero).alias("f1"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """(label, count, weight) with weight = n / (k * n_label) ('balanced')."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k")).first()  # one row
    if not tot["n"]:
        return counts.withColumn("weight", F.lit(None).cast("double"))
    return counts.withColumn("weight", F.lit(float(tot["n"])) / (F.lit(float(tot["k"])) * F.col("count")))


def with_class_weight(df: DataFrame, label: str, weight_col: str = "class_weight") -> DataFrame:
    """Attach A18's weight to each row (a join with the k-row weight table)."""
    w = class_balance(df, label).select(F.col("label").alias("__l"), F.col("weight").alias(weight_col))
    return df.join(w, F.col(label) == F.col("__l"), "left").drop("__l")


def select_best(metrics: DataFrame, task_col: str = "task", family_col: str = "family",
                score_col: str = "score", order_col: str = "priority") -> DataFrame:
    """Per task the family with the highest score; equal scores keep the earlier family."""
    return metrics.groupBy(task_col).agg(
        F.max_by(F.struct(F.col(family_col).alias("family"), F.col(score_col).alias("score")),
                 F.struct(F.col(score_col), -F.col(order_col))).alias("b")
    ).select(task_col, "b.family", "b.score")


METRIC_COLUMNS = ["task", "family", "r2", "mae", "rmse", "accuracy", "f1", "precision", "recall"]


def metric_table(spark, rows: Iterable[dict]) -> DataFrame:
    """One row per (task, family) with the regression or classification metrics."""
    data = [tuple(r.get(c) for c in METRIC_COLUMNS) for r in rows]
    schema = ("task string, family string, r2 double, mae double, rmse double, accuracy double, "
              "f1 double, precision double, recall double")
    return spark.createDataFrame(data, schema)
