"""The ``cohort`` view: the driver's tables seen as a student questionnaire.

One row per customer.  Grades are conditional means of the customer's order
prices per priority (capped at 20 points), screen/study/sleep hours
conditional means of event values per type, both computed as exact decimal
sums, the clocks are the first and last event times.  The plan is
two partial (map-side combined) aggregations and two equi-joins; no step
brings a group to one task, and a hot customer or user collapses to one row
per partition before the shuffle.

``COHORT_CTES`` is the same view in SQL for the DuckDB oracle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the view: order priority -> grade column, event type -> hours.
PRIORITY_GRADES = [
    ("1-URGENT", "note_francais"),
    ("2-HIGH", "note_maths"),
    ("3-MEDIUM", "note_histoire_geo"),
    ("4-NOT SPECIFIED", "note_sciences"),
]
EVENT_HOURS = [
    ("click", "heures_jeux_video", 25.0),
    ("view", "heures_reseaux_sociaux", 25.0),
    ("error", "heures_streaming", 25.0),
    ("purchase", "heures_etude_soir", 25.0),
    ("signup", "heures_sommeil", 7.0),
]
GRADE_PRICE_DIVISOR = 25000.0
GRADE_MAX_PRICE = 500000     # 20 points * divisor
MONEY = "decimal(18,2)"

COHORT_COLUMNS = [
    "id", "nom", "classe", "interet_maths", "activite_sportive", "stress_personnel",
    "heures_jeux_video", "heures_reseaux_sociaux", "heures_streaming",
    "heures_etude_soir", "heures_sommeil", "heure_lever", "heure_coucher",
    "note_francais", "note_maths", "note_histoire_geo", "note_sciences",
]


def _clock_text(ts, sep: str):
    return F.concat(F.hour(ts).cast("string"), F.lit(sep),
                    F.lpad(F.minute(ts).cast("string"), 2, "0"))


def _exact_mean(cond, value):
    """Mean of ``value`` where ``cond``: exact decimal sum, one double division.

    The inputs carry two decimals, so the sum is exact in any order and the
    result does not depend on how rows are split across tasks (a float sum
    would differ in the last bit between partitionings and engines).
    """
    total = F.sum(F.when(cond, value.cast(MONEY)))
    return F.try_divide(total.cast("double"), F.count(F.when(cond, F.lit(1))).cast("double"))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_totalprice")
    capped = F.least(F.lit(GRADE_MAX_PRICE).cast(MONEY), F.col("o_totalprice").cast(MONEY))
    g = orders.groupBy("o_custkey").agg(*[
        (_exact_mean(F.col("o_orderpriority") == prio, capped) / F.lit(GRADE_PRICE_DIVISOR)).alias(name)
        for prio, name in PRIORITY_GRADES
    ])

    events = read_table(spark, sf_dir, "events", "user_id", "event_type", "value", "ts")
    e = events.groupBy("user_id").agg(
        *[(_exact_mean(F.col("event_type") == kind, F.col("value")) / F.lit(div)).alias(name)
          for kind, name, div in EVENT_HOURS],
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )

    cust = read_table(spark, sf_dir, "customer",
                      "c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")
    joined = (cust.join(g, cust.c_custkey == g.o_custkey, "left")
                  .join(e, F.expr("c_custkey div 10") == e.user_id,
                        "left"))
    nk = F.col("c_nationkey")
    return joined.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("nom"),
        F.col("c_mktsegment").alias("classe"),
        nk.alias("interet_maths"),
        F.when(F.col("c_acctbal") > 5000, "oui").when(F.col("c_acctbal") > 0, "non")
         .alias("activite_sportive"),
        F.when(nk % 7 == 0, F.lit("n/d")).otherwise((nk % 5).cast("string"))
         .alias("stress_personnel"),
        "heures_jeux_video", "heures_reseaux_sociaux", "heures_streaming", "heures_etude_soir",
        F.when(F.col("c_custkey") % 11 != 0, F.col("heures_sommeil")).alias("heures_sommeil"),
        _clock_text(F.col("first_ts"), "h").alias("heure_lever"),
        _clock_text(F.col("last_ts"), ":").alias("heure_coucher"),
        "note_francais", "note_maths", "note_histoire_geo", "note_sciences",
    )


# The same view for DuckDB (oracle side).  Used as the leading CTEs of every
# oracle query: ``WITH {COHORT_CTES}, ... SELECT ...``.
COHORT_CTES = """
g AS (
  SELECT o_custkey,
    CAST(sum(CASE WHEN o_orderpriority='1-URGENT'        THEN least(500000::DECIMAL(18,2), o_totalprice::DECIMAL(18,2)) END) AS DOUBLE) / count(CASE WHEN o_orderpriority='1-URGENT'        THEN 1 END) / 25000e0 AS note_francais,
    CAST(sum(CASE WHEN o_orderpriority='2-HIGH'          THEN least(500000::DECIMAL(18,2), o_totalprice::DECIMAL(18,2)) END) AS DOUBLE) / count(CASE WHEN o_orderpriority='2-HIGH'          THEN 1 END) / 25000e0 AS note_maths,
    CAST(sum(CASE WHEN o_orderpriority='3-MEDIUM'        THEN least(500000::DECIMAL(18,2), o_totalprice::DECIMAL(18,2)) END) AS DOUBLE) / count(CASE WHEN o_orderpriority='3-MEDIUM'        THEN 1 END) / 25000e0 AS note_histoire_geo,
    CAST(sum(CASE WHEN o_orderpriority='4-NOT SPECIFIED' THEN least(500000::DECIMAL(18,2), o_totalprice::DECIMAL(18,2)) END) AS DOUBLE) / count(CASE WHEN o_orderpriority='4-NOT SPECIFIED' THEN 1 END) / 25000e0 AS note_sciences
  FROM orders GROUP BY o_custkey),
e AS (
  SELECT user_id,
    CAST(sum(CASE WHEN event_type='click'    THEN value::DECIMAL(18,2) END) AS DOUBLE) / count(CASE WHEN event_type='click'    THEN 1 END) / 25e0 AS heures_jeux_video,
    CAST(sum(CASE WHEN event_type='view'     THEN value::DECIMAL(18,2) END) AS DOUBLE) / count(CASE WHEN event_type='view'     THEN 1 END) / 25e0 AS heures_reseaux_sociaux,
    CAST(sum(CASE WHEN event_type='error'    THEN value::DECIMAL(18,2) END) AS DOUBLE) / count(CASE WHEN event_type='error'    THEN 1 END) / 25e0 AS heures_streaming,
    CAST(sum(CASE WHEN event_type='purchase' THEN value::DECIMAL(18,2) END) AS DOUBLE) / count(CASE WHEN event_type='purchase' THEN 1 END) / 25e0 AS heures_etude_soir,
    CAST(sum(CASE WHEN event_type='signup'   THEN value::DECIMAL(18,2) END) AS DOUBLE) / count(CASE WHEN event_type='signup'   THEN 1 END) / 7e0  AS heures_sommeil,
    min(ts) AS first_ts, max(ts) AS last_ts
  FROM events GROUP BY user_id),
cohort AS (
SELECT c_custkey AS id, c_name AS nom, c_mktsegment AS classe,
  c_nationkey AS interet_maths,
  CASE WHEN c_acctbal > 5000 THEN 'oui' WHEN c_acctbal > 0 THEN 'non' END AS activite_sportive,
  CASE WHEN c_nationkey % 7 = 0 THEN 'n/d' ELSE cast(c_nationkey % 5 AS varchar(4)) END AS stress_personnel,
  heures_jeux_video, heures_reseaux_sociaux, heures_streaming, heures_etude_soir,
  CASE WHEN c_custkey % 11 <> 0 THEN heures_sommeil END AS heures_sommeil,
  cast(hour(first_ts) AS varchar(4)) || 'h' || lpad(cast(minute(first_ts) AS varchar(4)), 2, '0') AS heure_lever,
  cast(hour(last_ts) AS varchar(4)) || ':' || lpad(cast(minute(last_ts) AS varchar(4)), 2, '0') AS heure_coucher,
  note_francais, note_maths, note_histoire_geo, note_sciences
FROM customer LEFT JOIN g ON c_custkey = o_custkey LEFT JOIN e ON c_custkey // 10 = user_id)
"""
