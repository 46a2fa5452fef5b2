"""Feature derivation (C2, C3) as one projection each.

Both functions only add columns with native expressions; the input DataFrame
is left unchanged (DataFrames are immutable) and no job runs.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import expr as X
from .columns import column_mapping

# Columns produced by ``add_features``; never fed back into the motivation index.
DERIVED = ["temps_ecrans_total", "score_equilibre", "ratio_etude_ecrans",
           "stress_total", "indice_motivation", K.TARGET_CLF]


def add_clock_features(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """``<column>_num`` hours for the bedtime and wake-up columns."""
    mapping = column_mapping(df.columns) if mapping is None else mapping
    extra = {}
    for concept in K.CLOCK_COLUMNS:
        col = mapping.get(concept)
        if col and col in df.columns:
            extra[f"{col}_num"] = X.parse_clock(col)
    return df.withColumns(extra) if extra else df


def add_features(df: DataFrame, mapping: Mapping[str, str] | None = None,
                 threshold: float = K.PASS_THRESHOLD) -> DataFrame:
    """Screen total, balance score, study ratio, stress, motivation, pass label."""
    mapping = column_mapping(df.columns) if mapping is None else dict(mapping)
    types = {f.name: f.dataType for f in df.schema.fields}

    def mapped(concept):
        col = mapping.get(concept)
        return col if col and col in types else None

    sport_col = mapped("sport")
    sport = X.truthy(sport_col) if sport_col else F.lit(0)
    screen_cols = [mapped(c) for c in ("jeux_video", "reseaux", "streaming") if mapped(c)]
    screens = X.row_sum([X.to_number(c, types[c]) for c in screen_cols]) if screen_cols else F.lit(0)
    sleep = X.to_number(mapped("sommeil"), types[mapped("sommeil")]) if mapped("sommeil") \
        else F.lit(K.DEFAULT_SLEEP_HOURS)
    study = X.to_number(mapped("etude"), types[mapped("etude")]) if mapped("etude") \
        else F.lit(K.DEFAULT_STUDY_HOURS)
    stress = X.stress_number(mapped("stress"), types[mapped("stress")]) if mapped("stress") \
        else F.lit(0)
    interest = [(c, types[c]) for c in df.columns
                if c not in DERIVED and any(w in c.lower() for w in K.MOTIVATION_WORDS)]

    screens_col = F.col("temps_ecrans_total")
    out = df.drop(*[c for c in DERIVED if c in df.columns]).withColumns({
        "temps_ecrans_total": screens,
    })
    derived = {
        "score_equilibre": X.balance_score(sleep, sport, screens_col, study),
        "ratio_etude_ecrans": X.study_ratio(study, screens_col),
        "stress_total": stress,
        "indice_motivation": X.motivation_index(interest),
    }
    note = mapped("note_moyenne")
    if note:
        derived[K.TARGET_CLF] = X.pass_label(note, threshold)
    return out.withColumns(derived)
