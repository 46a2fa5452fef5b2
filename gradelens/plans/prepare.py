"""The reference's preprocessing chain as one reusable plan.

cohort -> row mean of the grades (``note_moyenne``) -> clean -> clock
features -> derived features.  The raw cohort is materialised once as a
Parquet table in ``spark.checkpoint.dir`` because fitting the cleaner makes
several passes over it; at scale this turns two shuffling joins per pass into
one pruned columnar scan per pass.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as K
from ..functions import expr as X
from ..operators.clean import clean
from ..operators.columns import nan_to_null
from ..operators.features import add_clock_features, add_features
from ..session import cut_lineage
from ..sources.cohort import cohort


def with_row_mean(df: DataFrame, target: str = K.TARGET_REG) -> DataFrame:
    """X5 applied: ``note_moyenne`` = mean of the grade columns present."""
    return df.withColumn(target, X.row_mean([c for c in K.GRADE_COLUMNS if c in df.columns]))


def raw_cohort(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The cohort view with NaN normalised to NULL and the row-mean grade."""
    raw = with_row_mean(nan_to_null(cohort(spark, sf_dir)))
    return cut_lineage(raw) if materialize else raw


def prepare(raw: DataFrame, threshold: float = K.PASS_THRESHOLD) -> DataFrame:
    """Cleaned, with clock and derived features."""
    return add_features(add_clock_features(clean(raw)), threshold=threshold)


def prepared_cohort(spark: SparkSession, sf_dir: str, threshold: float = K.PASS_THRESHOLD,
                    materialize: bool = True) -> DataFrame:
    """The model-ready cohort."""
    return prepare(raw_cohort(spark, sf_dir, materialize), threshold)
