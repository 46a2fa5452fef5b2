"""SQL building blocks for the DuckDB oracles (independent re-statements of
the operators' semantics in plain SQL; nothing here runs on Spark)."""
from __future__ import annotations

from ..functions import constants as K
from ..functions.expr import NUMERIC_TEXT
from ..sources.cohort import COHORT_CTES

COHORT_TEXT = ["nom", "classe", "activite_sportive", "stress_personnel", "heure_lever", "heure_coucher"]
COHORT_DOUBLE = ["heures_jeux_video", "heures_reseaux_sociaux", "heures_streaming", "heures_etude_soir",
                 "heures_sommeil", "note_francais", "note_maths", "note_histoire_geo", "note_sciences",
                 "note_moyenne"]
COHORT_GRADES = ["note_francais", "note_maths", "note_histoire_geo", "note_sciences"]
RAW_ORDER = ["id", "nom", "classe", "interet_maths", "activite_sportive", "stress_personnel",
             "heures_jeux_video", "heures_reseaux_sociaux", "heures_streaming", "heures_etude_soir",
             "heures_sommeil", "heure_lever", "heure_coucher", "note_francais", "note_maths",
             "note_histoire_geo", "note_sciences", "note_moyenne"]


def sql_str(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def num(x: str) -> str:
    """Guarded text -> double."""
    return f"(CASE WHEN regexp_matches(trim(CAST({x} AS VARCHAR)), '{NUMERIC_TEXT}') " \
           f"THEN TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE) END)"


def clock(x: str) -> str:
    s = f"replace(lower(CAST({x} AS VARCHAR)), 'h', ':')"
    p1, p2 = f"split_part({s}, ':', 1)", f"split_part({s}, ':', 2)"
    return (f"coalesce(CASE WHEN instr({s}, ':') > 0 THEN {num(p1)} + "
            f"(CASE WHEN {p2} = '' THEN 0.0 ELSE {num(p2)} END) / 60.0 ELSE {num(s)} END, 0.0)")


def row_mean(cols: list[str]) -> str:
    total = " + ".join(f"coalesce(CAST({c} AS DOUBLE), 0)" for c in cols)
    cnt = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols)
    return f"(({total}) / nullif({cnt}, 0))"


def truthy(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in K.TRUTHY_TEXT)
    return f"coalesce(CAST(lower(CAST({x} AS VARCHAR)) IN ({words}) AS INTEGER), 0)"


def _median(c: str) -> str:
    return f"(SELECT median({c}) FROM raw)"


def _mode(c: str) -> str:
    return (f"(SELECT {c} FROM raw WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


RAW_CTE = f"raw AS (SELECT *, {row_mean(COHORT_GRADES)} AS note_moyenne FROM cohort)"

CLEAN_COLS = ", ".join(
    f"coalesce({c}, {_median(c)}) AS {c}" if c in COHORT_DOUBLE else
    f"coalesce({c}, {_mode(c)}) AS {c}" if c in COHORT_TEXT else c
    for c in RAW_ORDER)
CLEAN_CTE = f"clean AS (SELECT {CLEAN_COLS} FROM raw)"

SCREENS = "coalesce(heures_jeux_video, 0) + coalesce(heures_reseaux_sociaux, 0) + coalesce(heures_streaming, 0)"


def feat_ctes(src: str, out: str, extra_cols: str = "") -> str:
    """C2 + C3 over CTE ``src`` as CTEs ``{out}0`` and ``{out}``."""
    return f"""{out}0 AS (SELECT *, {clock('heure_coucher')} AS heure_coucher_num,
  {clock('heure_lever')} AS heure_lever_num, {SCREENS} AS temps_ecrans_total FROM {src}),
{out} AS (SELECT *,
  (heures_sommeil + {truthy('activite_sportive')} * 2) / nullif(temps_ecrans_total + heures_etude_soir + 1, 0) AS score_equilibre,
  heures_etude_soir / nullif(temps_ecrans_total + 0.5, 0) AS ratio_etude_ecrans,
  coalesce({num('stress_personnel')}, 0.0) AS stress_total,
  coalesce({row_mean(['interet_maths'])}, 5.0) AS indice_motivation,
  CAST(coalesce(note_moyenne >= 10, false) AS INTEGER) AS reussite{extra_cols}
FROM {out}0)"""


FEAT_CTE = feat_ctes("clean", "feat")

# Weighted grade (X11) over the prepared cohort's columns, in the scorer's term order.
COHORT_WEIGHTS = {("stress_total" if k == "stress_personnel" else k): v for k, v in K.SCORE_WEIGHTS.items()}
PREP_NUMERIC = ["id", "interet_maths", "heures_jeux_video", "heures_reseaux_sociaux", "heures_streaming",
                "heures_etude_soir", "heures_sommeil", "note_francais", "note_maths", "note_histoire_geo",
                "note_sciences", "note_moyenne", "heure_coucher_num", "heure_lever_num", "temps_ecrans_total",
                "score_equilibre", "ratio_etude_ecrans", "stress_total", "indice_motivation", "reussite"]


def linear_sql(base: float, present: list[str] = PREP_NUMERIC, weights=COHORT_WEIGHTS,
               sport: bool = True) -> str:
    total = "0.0"
    for name, w in weights.items():
        if name in present:
            total = f"({total} + CAST({name} AS DOUBLE) * CAST({float(w)!r} AS DOUBLE))"
    if sport:
        total = f"({total} + CASE WHEN activite_sportive = 'oui' THEN 1.0 ELSE 0.0 END)"
    inner = f"((CAST({float(base)!r} AS DOUBLE) + {total}) - 7.5)"
    return f"(CASE WHEN {inner} IS NOT NULL THEN greatest(0.0, least(20.0, {inner})) END)"


def grades_sql() -> str:
    """Per-subject linear grades and their mean, as select-list items."""
    items = [f"{linear_sql(b)} AS pred_{s.replace('note_', '')}" for s, b in K.SUBJECT_BASES.items()]
    return ", ".join(items)


def pred_mean_sql() -> str:
    cols = [f"pred_{s.replace('note_', '')}" for s in K.SUBJECT_BASES]
    return row_mean(cols)


# Every oracle starts with these CTEs: cohort, raw (row mean), clean, feat.
PREP = f"WITH {COHORT_CTES.strip()},\n{RAW_CTE},\n{CLEAN_CTE},\n{FEAT_CTE}"
BASE = f"WITH {COHORT_CTES.strip()},\n{RAW_CTE}"


def rounded(sql: str, doubles: list[str], digits: int = 6) -> str:
    """Round the listed double columns of a query's result."""
    if not doubles:
        return sql
    rep = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS q"
