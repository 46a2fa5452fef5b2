"""Connected components of an edge table by label propagation with pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelens.session import cut_lineage


def thinned(edges: DataFrame) -> DataFrame:
    """``a, b``, fewer edges that connect the same nodes: a node keeps the one to its smallest neighbour below it, which also takes its others."""
    low = F.min("a").over(Window.partitionBy("b"))
    down = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    return down.withColumn("low", low).select(F.col("low").alias("a"), F.when(F.col("a") == F.col("low"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node reachable over the edges, for every node that has one.

    Each round a node takes the smallest label among its neighbours and then the
    label of its label, so a chain shortens by halves; rounds end when no label
    changes.  Labels and edges are tables in the shared checkpoint folder.  Edges are
    thinned before, since a node of many forests brings one of each.

    Defined cases: no edges, or only edges from nodes to themselves, give no rows; repeated
    edges are one, in either direction; nodes are not null; other columns are not read.
    """
    few = thinned(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    both = cut_lineage(few.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(few.select("b", "a")))
    labels = cut_lineage(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        nxt = cut_lineage(hooked.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")))
        labels = nxt.select("node", "root")
        if nxt.where("old <> root").isEmpty():
            return labels
