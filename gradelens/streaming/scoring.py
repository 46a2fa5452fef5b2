"""Score questionnaire rows as they arrive (Structured Streaming).

Cleaning values (medians, modes) are frozen from a batch ``fit_clean`` and
the fitted pipelines are stateless transformers, so the whole chain
clean -> clocks -> features -> models runs unchanged on a stream: no state
store, no watermark, each micro-batch is independent.  Output and progress
go to the shared checkpoint folder named by ``spark.checkpoint.dir`` unless
the caller passes explicit locations.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..ml.scoring import pass_probability, predict
from ..operators.clean import CleanModel
from ..operators.features import add_clock_features, add_features
from ..session import ensure_checkpoint_dir


def read_rows(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
              max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def score_rows(rows: DataFrame, cleaner: CleanModel, reg_model: PipelineModel,
               clf_model: PipelineModel | None = None, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Apply the frozen cleaning, the features and the models (batch or stream)."""
    df = add_features(add_clock_features(cleaner.transform(rows), mapping), mapping)
    out = predict(reg_model, df, "note_predite")
    if clf_model is not None:
        out = pass_probability(clf_model, out)
    return out


def start(scored: DataFrame, name: str, sink: str | None = None, fmt: str = "parquet",
          checkpoint: str | None = None, trigger_seconds: int | None = None) -> StreamingQuery:
    """Write a scored stream; defaults put sink and progress under spark.checkpoint.dir."""
    base = ensure_checkpoint_dir(scored.sparkSession).rstrip("/")
    w = scored.writeStream.queryName(name).outputMode("append") \
        .option("checkpointLocation", checkpoint or f"{base}/streams/{name}/_progress")
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    if fmt == "memory":
        return w.format("memory").start()
    return w.format(fmt).option("path", sink or f"{base}/streams/{name}/out").start()
