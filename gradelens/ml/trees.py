"""Spark's own tree models from trees that were grown elsewhere.

Spark ML has no public constructor of a tree model; its saved form is public.  A model of one
small tree is fitted and saved for its metadata, the trees are written in its place, and Spark loads them.
"""
from __future__ import annotations

import json
import uuid

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import SparkSession

from ..session import ensure_checkpoint_dir

#: A tree's node: children come after their parent, the root is 0.
NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
         "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def load_trees(estimator, spark: SparkSession, nodes, weights: list[float], features: int, classes: int = 2):
    """The fitted model of ``estimator`` whose trees are ``nodes``: a list or an RDD of ``NODES`` rows."""
    forest = isinstance(estimator, RandomForestClassifier)
    trees = "numTrees" if forest else "maxIter"
    label, weight = estimator.getLabelCol(), estimator.getOrDefault("weightCol") if estimator.isDefined("weightCol") else None
    zero = Vectors.sparse(features, {})
    few = spark.createDataFrame([(zero, float(k), *([1.0] if weight else [])) for k in range(classes)],
                                [estimator.getFeaturesCol(), label, *([weight] if weight else [])])
    small = estimator.copy({estimator.getParam(trees): 1, estimator.maxDepth: 1}).fit(few)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees_{uuid.uuid4().hex}"
    small.write().save(f"{path}/small")
    about = json.loads(spark.read.text(f"{path}/small/metadata").first()[0])
    about["paramMap"].update({p: estimator.getOrDefault(p) for p in (trees, "maxDepth")})
    about.update(numFeatures=features, numTrees=len(weights), uid=estimator.uid)
    one = spark.read.parquet(f"{path}/small/treesMetadata")
    own = json.loads(one.first()[1])
    own["paramMap"]["maxDepth"] = estimator.getMaxDepth()
    kind = own["uid"].split("_")[0]
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/whole/metadata")
    spark.createDataFrame([(k, json.dumps({**own, "uid": f"{kind}_{uuid.uuid4().hex[:12]}"}), float(w)) for k, w in enumerate(weights)],
                          one.schema).coalesce(1).write.parquet(f"{path}/whole/treesMetadata")
    spark.createDataFrame(nodes, NODES, verifySchema=False).write.parquet(f"{path}/whole/data")
    model = (RandomForestClassificationModel if forest else GBTRegressionModel).load(f"{path}/whole")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return model
