"""Named queries over the driver's tables (the ``queries()`` catalogue).

Every query reads whole tables (through the ``cohort`` view or directly) and
runs the library's own operators; each has a DuckDB oracle unless it is a
model fit (rows-only check, property tests in ``tests/``).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.cohort import cohort_summary
from ..sources.cohort import cohort
from .prepare import prepared_cohort, with_row_mean
from .registry import query
from .sql import BASE, PREP

# ------------------------------------------------------------------ base ---

@query("cohort_base", sql=f"{BASE} SELECT * FROM cohort",
       doubles=["heures_jeux_video", "heures_reseaux_sociaux", "heures_streaming", "heures_etude_soir",
                "heures_sommeil", "note_francais", "note_maths", "note_histoire_geo", "note_sciences"])
def cohort_base(spark, sf_dir):
    """The cohort view (two aggregations, two equi-joins)."""
    return cohort(spark, sf_dir)


@query("row_mean_label",
       sql=f"{BASE} SELECT id, note_moyenne, CAST(coalesce(note_moyenne >= 10, false) AS INTEGER) AS reussite "
           f"FROM raw",
       doubles=["note_moyenne"])
def row_mean_label(spark, sf_dir):
    """X5 + X10: row mean of the grades and the pass label (NULL mean -> 0)."""
    from ..functions.expr import pass_label
    raw = with_row_mean(cohort(spark, sf_dir))
    return raw.select("id", "note_moyenne", pass_label("note_moyenne").alias("reussite"))


@query("cohort_summary_by_class",
       sql=f"""{PREP}
SELECT classe, count(*) AS n_students, avg(note_moyenne) AS mean_grade,
  count(*) FILTER (WHERE note_moyenne >= 10) AS n_passed,
  count(*) - count(*) FILTER (WHERE note_moyenne >= 10) AS n_failed,
  coalesce((count(*) FILTER (WHERE note_moyenne >= 10)) * 100.0 / nullif(count(*), 0), 0) AS pass_rate
FROM feat GROUP BY classe""",
       doubles=["mean_grade", "pass_rate"])
def cohort_summary_by_class(spark, sf_dir):
    """Flagship: cohort -> row mean -> clean -> clocks -> features -> A12 by class."""
    return cohort_summary(prepared_cohort(spark, sf_dir), K.TARGET_REG, K.PASS_THRESHOLD, by=["classe"])


# Further catalogue sections register themselves on import.
from . import catalogue_profile  # noqa: E402,F401
from . import catalogue_scores  # noqa: E402,F401
from . import catalogue_models  # noqa: E402,F401
