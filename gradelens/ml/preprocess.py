"""Preprocessing stages (M2-M4) and feature selection (M5, M20) for Spark ML pipelines.

* ``PopulationScaler``: z-score with the *population* std (a constant column
  maps to 0).  Its fit is one aggregation (two numbers per column); the
  fitted stage is a built-in ``SQLTransformer`` so pipelines save and load
  with Spark's own writers.
* one-hot: ``StringIndexer(alphabetAsc, keep)`` + ``OneHotEncoder(dropLast)``:
  every training category gets an indicator; unknown and NULL give zeros.
* ``ImportanceSelector``: 50-tree random forest importances, keep features
  with importance >= 0.5 x mean; the fitted stage is a ``VectorSlicer``.
"""
from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasOutputCol, HasOutputCols, HasSeed
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class PopulationScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """M2: (x - mean) / std_pop per column; fitted form is an SQLTransformer."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        cols, outs = self.getInputCols(), self.getOutputCols()
        row = dataset.agg(*[e for i, c in enumerate(cols) for e in
                            (F.avg(F.col(c).cast("double")).alias(f"m{i}"),
                             F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}"))]).first()
        items = []
        for i, (c, o) in enumerate(zip(cols, outs)):
            m, s = row[f"m{i}"], row[f"s{i}"]
            x = f"CAST({_q(c)} AS DOUBLE)"
            if m is None:
                expr = "CAST(NULL AS DOUBLE)"
            elif not s:
                expr = f"CASE WHEN {x} IS NULL THEN NULL ELSE 0.0 END"
            else:
                expr = f"({x} - CAST({m!r} AS DOUBLE)) / CAST({s!r} AS DOUBLE)"
            items.append(f"{expr} AS {_q(o)}")
        return SQLTransformer(statement=f"SELECT *, {', '.join(items)} FROM __THIS__")


def preprocessing_stages(num_cols: list[str], cat_cols: list[str], features_col: str = "features") -> list:
    """M4: scaler on numerics, one-hot on text, assembled into one vector (numerics first)."""
    stages: list = []
    parts = []
    if num_cols:
        z = [f"{c}__z" for c in num_cols]
        stages.append(PopulationScaler(inputCols=num_cols, outputCols=z))
        parts += z
    if cat_cols:
        idx = [f"{c}__idx" for c in cat_cols]
        oh = [f"{c}__oh" for c in cat_cols]
        stages.append(StringIndexer(inputCols=cat_cols, outputCols=idx, stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=oh, dropLast=True, handleInvalid="keep"))
        parts += oh
    stages.append(VectorAssembler(inputCols=parts, outputCol=features_col, handleInvalid="keep"))
    return stages


def feature_columns(df: DataFrame, exclude: list[str]) -> tuple[list[str], list[str]]:
    """Numeric (not boolean) and text model inputs of ``df`` minus ``exclude``."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
    txt = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    return num, txt


def vector_names(df: DataFrame, col: str = "features") -> list[str]:
    """Names of the slots of an assembled vector: numerics, then ``<column>_<category>``."""
    attrs = df.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a["name"]) for kind in attrs.values() for a in kind)
    names = []
    for _, n in slots:
        n = n.replace("__z", "")
        if "__oh_" in n:
            base, cat = n.split("__oh_", 1)
            n = f"{base}_{cat}"
        names.append(n)
    return names


class ImportanceSelector(Estimator, HasFeaturesCol, HasLabelCol, HasOutputCol, HasSeed,
                         DefaultParamsReadable, DefaultParamsWritable):
    """M5: keep the slots whose forest importance is >= factor x mean importance."""

    task = Param(Params._dummy(), "task", "regression or classification", TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "trees of the ranking forest", TypeConverters.toInt)
    factor = Param(Params._dummy(), "factor", "threshold as a multiple of the mean", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", outputCol="selected",
                 task="regression", numTrees=K.SELECTOR_TREES, factor=K.SELECTOR_FACTOR, seed=K.SEED):
        super().__init__()
        self._setDefault(task="regression", numTrees=K.SELECTOR_TREES, factor=K.SELECTOR_FACTOR)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        cls = RandomForestRegressor if self.getOrDefault(self.task) == "regression" else RandomForestClassifier
        forest = cls(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                     numTrees=self.getOrDefault(self.numTrees), seed=self.getSeed()).fit(dataset)
        imp = forest.featureImportances.toArray()
        cut = self.getOrDefault(self.factor) * (imp.mean() if len(imp) else 0.0)
        keep = [i for i, v in enumerate(imp) if v >= cut] or list(range(len(imp)))
        return VectorSlicer(inputCol=self.getFeaturesCol(), outputCol=self.getOutputCol(), indices=keep)


def selected_features(model, sample: DataFrame) -> DataFrame:
    """(feature, kept) for every assembled slot of a fitted pipeline.

    ``sample`` is any frame with the training schema (``limit(1)`` is enough):
    the slot names come from the assembler's metadata, the mask from the slicer.
    """
    from pyspark.ml.feature import VectorSlicer as VS
    stages = model.stages
    slicer = next((s for s in stages if isinstance(s, VS)), None)
    pre = sample
    for s in stages:
        if s is slicer:
            break
        pre = s.transform(pre)
    names = vector_names(pre, slicer.getInputCol() if slicer else "features")
    kept = set(slicer.getIndices()) if slicer else set(range(len(names)))
    spark = sample.sparkSession
    return spark.createDataFrame([(i, n, i in kept) for i, n in enumerate(names)],
                                 "position int, feature string, kept boolean")
