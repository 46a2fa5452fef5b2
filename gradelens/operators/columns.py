"""Column metadata and projections.

Everything here inspects ``df.columns`` / ``df.schema`` (no job) or builds a
single projection; none of it triggers a scan except ``preview``'s action.
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    """S3: raise ValueError listing the required columns that are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case every column name; refuse names that collide."""
    lowered = [c.lower() for c in df.columns]
    dupes = sorted({c for c in lowered if lowered.count(c) > 1})
    if dupes:
        raise ValueError(f"column names collide after lower-casing: {dupes}")
    return df.toDF(*lowered)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn floating NaN into NULL once, at ingest (pandas' missing marker)."""
    fixed = [F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
             if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
             for f in df.schema.fields]
    return df.select(*fixed)


def column_mapping(columns: Iterable[str]) -> dict[str, str]:
    """Concept -> first column containing the concept's first matching keyword.

    Keywords are tried in list order; for each keyword the first column (in
    column order) whose lower-cased name contains it wins.  Unmatched concepts
    are left out; one column may serve several concepts.
    """
    columns = list(columns)
    lowered = [str(c).lower() for c in columns]
    mapping: dict[str, str] = {}
    for concept, words in K.KEYWORDS.items():
        hit = next(((w, i) for w in words for i, c in enumerate(lowered) if w in c), None)
        if hit is not None:
            mapping[concept] = columns[hit[1]]
    return mapping


def override_mapping(mapping: Mapping[str, str], user: Mapping[str, str | None],
                     columns: Iterable[str]) -> dict[str, str]:
    """User choices replace the automatic mapping; ``None`` removes a concept."""
    columns = set(columns)
    merged = dict(mapping)
    for concept, col in user.items():
        if concept not in K.KEYWORDS:
            raise ValueError(f"unknown concept {concept!r}")
        if col is None:
            merged.pop(concept, None)
        elif col not in columns:
            raise ValueError(f"column {col!r} for {concept!r} not in the table")
        else:
            merged[concept] = col
    return merged


def model_drop_list(columns: Iterable[str], target: str = K.TARGET_REG,
                    uploaded: bool = False) -> list[str]:
    """Columns removed before modelling (P4), plus both targets."""
    columns = list(columns)
    if uploaded:
        drop = [c for c in columns if c.lower() in K.UPLOAD_ID_COLUMNS]
    else:
        drop = [c for c in K.COLS_TO_DROP if c in columns]
    drop += [c for c in (target, K.TARGET_CLF) if c in columns and c not in drop]
    return drop


def drop_model_columns(df: DataFrame, target: str = K.TARGET_REG, uploaded: bool = False,
                       keep: Iterable[str] = ()) -> DataFrame:
    """Drop identity, grade and clock columns and both targets (``keep`` survives)."""
    keep = set(keep)
    return df.drop(*[c for c in model_drop_list(df.columns, target, uploaded) if c not in keep])


def align_features(df: DataFrame, feature_cols: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """P5: add missing model columns as 0 and keep the model's columns in order."""
    present = set(df.columns)
    keep = [c for c in keep if c in present]
    return df.select(*keep, *[F.col(c) if c in present else F.lit(0).alias(c) for c in feature_cols
                              if c not in keep])


def columns_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric columns, text columns); booleans are neither."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    txt = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return num, txt


def new_columns(before: Iterable[str], after: Iterable[str]) -> list[str]:
    """Names present after but not before, in order."""
    before = set(before)
    return [c for c in after if c not in before]


def identity_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """Identity columns (case-insensitive) plus the target when present."""
    ident = [c for c in df.columns if c.lower() in K.PREDICTION_ID_COLUMNS]
    if target and target in df.columns:
        ident.append(target)
    return ident


def displayable_columns(df: DataFrame) -> list[str]:
    """Columns shown by the profiler (names, address, id, mail hidden)."""
    hidden = {x.lower() for x in K.PROFILE_HIDDEN_COLUMNS}
    return [c for c in df.columns if c.lower() not in hidden]


def default_target(df: DataFrame) -> tuple[str | None, float]:
    """P10: ``note_moyenne`` when numeric and present, else the first numeric column."""
    num, _ = columns_by_type(df)
    if K.TARGET_REG in num:
        return K.TARGET_REG, K.PASS_THRESHOLD
    return (num[0] if num else None), K.PASS_THRESHOLD


def preview(df: DataFrame, n: int = 20, id_col: str = "id") -> DataFrame:
    """First ``n`` rows in id order (TakeOrderedAndProject: bounded per task)."""
    return df.orderBy(id_col).limit(n)


def missing_features(model_cols: Iterable[str], df: DataFrame) -> list[str]:
    """O1: model columns absent from ``df``."""
    present = set(df.columns)
    return [c for c in model_cols if c not in present]


def with_row_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Give a table without identity an explicit id (stable once persisted)."""
    if id_col in df.columns:
        return df
    return df.withColumn(id_col, F.monotonically_increasing_id())
