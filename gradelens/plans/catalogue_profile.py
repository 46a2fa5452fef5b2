"""Catalogue: cleaning, clocks, derived features and profiling queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import expr as X
from ..operators import profile as P
from ..operators.clean import clean
from ..operators import columns as C
from ..operators.cohort import class_guard, missing_only, subject_stats
from ..operators.columns import preview
from ..operators.features import add_clock_features
from .prepare import prepared_cohort, raw_cohort
from .registry import query
from .sql import BASE, COHORT_DOUBLE, COHORT_TEXT, PREP, RAW_ORDER, clock, num, truthy
from ..sources.tables import read_table

PREP_DOUBLES = COHORT_DOUBLE + ["heure_coucher_num", "heure_lever_num", "temps_ecrans_total",
                                "score_equilibre", "ratio_etude_ecrans", "stress_total", "indice_motivation"]
FEATURE_COLS = ["id", "temps_ecrans_total", "score_equilibre", "ratio_etude_ecrans", "stress_total",
                "indice_motivation", "reussite"]


@query("clean_median_mode", sql=f"{PREP} SELECT {', '.join(RAW_ORDER)} FROM clean", doubles=COHORT_DOUBLE)
def clean_median_mode(spark, sf_dir):
    """C1 (A9-A11): drop empty columns, exact median for numbers, mode for text."""
    return clean(raw_cohort(spark, sf_dir))


@query("clock_parse",
       sql=f"{BASE} SELECT id, heure_lever, heure_coucher, {clock('heure_coucher')} AS heure_coucher_num, "
           f"{clock('heure_lever')} AS heure_lever_num FROM raw",
       doubles=["heure_coucher_num", "heure_lever_num"])
def clock_parse(spark, sf_dir):
    """Clock text ('3h30', '17:27') to hours for both clock columns."""
    df = add_clock_features(raw_cohort(spark, sf_dir, materialize=False))
    return df.select("id", "heure_lever", "heure_coucher", "heure_coucher_num", "heure_lever_num")


_EV_HM = "lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || '{sep}' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0')"


@query("clock_format_events",
       sql=f"SELECT event_id, {_EV_HM.format(sep=':')} AS clock_text, "
           f"{clock('(' + _EV_HM.format(sep='h') + ')')} AS hours FROM events",
       doubles=["hours"])
def clock_format_events(spark, sf_dir):
    """X17 + X1 on every event: HH:MM text of the event time, and 'HHhMM' parsed back to hours."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts")
    h, m = F.hour("ts"), F.minute("ts")
    return ev.select("event_id", X.format_clock(h, m).alias("clock_text"),
                     X.parse_clock(F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit("h"),
                                            F.lpad(m.cast("string"), 2, "0"))).alias("hours"))


@query("sport_stress_flags",
       sql=f"{BASE} SELECT id, activite_sportive, stress_personnel, {truthy('activite_sportive')} AS sport, "
           f"{num('stress_personnel')} AS stress_number, coalesce({num('stress_personnel')}, 0.0) AS stress_total "
           f"FROM raw",
       doubles=["stress_number", "stress_total"])
def sport_stress_flags(spark, sf_dir):
    """X2, X3, X8 on raw text: sport flag, guarded number ('n/d' -> NULL), stress with NULL -> 0."""
    raw = raw_cohort(spark, sf_dir, materialize=False)
    return raw.select("id", "activite_sportive", "stress_personnel",
                      X.truthy("activite_sportive").alias("sport"),
                      X.to_number("stress_personnel").alias("stress_number"),
                      X.stress_number("stress_personnel").alias("stress_total"))


@query("derived_features", sql=f"{PREP} SELECT {', '.join(FEATURE_COLS)} FROM feat",
       doubles=FEATURE_COLS[1:-1])
def derived_features(spark, sf_dir):
    """C3 (X4, X6-X10): screen total, balance, study ratio, stress, motivation, pass label."""
    return prepared_cohort(spark, sf_dir).select(*FEATURE_COLS)


def _union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


_NULLS_SQL = _union_sql([f"SELECT {i} AS position, '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls "
                         f"FROM raw" for i, c in enumerate(RAW_ORDER)])


@query("null_report", sql=f"{BASE} {_NULLS_SQL}")
def null_report(spark, sf_dir):
    """A1: NULLs per column of the raw cohort (one aggregation)."""
    return P.null_counts(raw_cohort(spark, sf_dir, materialize=False))


@query("missing_columns",
       sql=f"{BASE} SELECT * FROM ({_NULLS_SQL}) AS n WHERE nulls > 0")
def missing_columns(spark, sf_dir):
    """A1 + F3: only the cohort columns that have NULLs, with their NULL counts."""
    return missing_only(P.null_counts(raw_cohort(spark, sf_dir, materialize=False)))


_CLEAN_NULLS = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in RAW_ORDER)


@query("null_before_after",
       sql=f"{PREP} SELECT (SELECT {_CLEAN_NULLS} FROM raw) AS nulls_before, "
           f"(SELECT {_CLEAN_NULLS} FROM clean) AS nulls_after")
def null_before_after(spark, sf_dir):
    """A2: total NULL cells before and after cleaning."""
    raw = raw_cohort(spark, sf_dir)
    return P.total_nulls(raw, clean(raw))


def _describe_sql(table: str, cols: list[str]) -> str:
    return _union_sql([
        f"SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
        f"quantile_cont({c}, 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {table}" for c in cols])


_DESC_COHORT = ["id", "interet_maths"] + [c for c in RAW_ORDER if c in COHORT_DOUBLE]
_DESC_STATS = ["mean", "std", "min", "q25", "q50", "q75", "max"]


@query("describe_cohort", sql=f"{BASE} {_describe_sql('raw', _DESC_COHORT)}", doubles=_DESC_STATS)
def describe_cohort(spark, sf_dir):
    """A3 on the raw cohort: moments and exact linear quartiles of every numeric column."""
    return P.describe(raw_cohort(spark, sf_dir))


_LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_lineitem", sql=_describe_sql("lineitem", _LINE_COLS), doubles=_DESC_STATS)
def describe_lineitem(spark, sf_dir):
    """A3 on lineitem (60k rows at sf0.01: exercises the bracketing quantile search)."""
    return P.describe(read_table(spark, sf_dir, "lineitem", *_LINE_COLS))


@query("distinct_counts",
       sql=f"{BASE} " + _union_sql([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM raw"
                                    for c in RAW_ORDER]))
def distinct_counts(spark, sf_dir):
    """A4: distinct non-NULL values of every cohort column."""
    return P.distinct_counts(raw_cohort(spark, sf_dir, materialize=False))


@query("value_counts_type",
       sql="SELECT event_type AS value, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def value_counts_type(spark, sf_dir):
    """A5: value counts of the event type over the whole events table."""
    return P.value_counts(read_table(spark, sf_dir, "events", "event_type"), "event_type")


@query("top_values_type",
       sql="SELECT p_type AS value, count(*) AS count FROM part WHERE p_type IS NOT NULL "
           "GROUP BY 1 ORDER BY count DESC, value LIMIT 20")
def top_values_type(spark, sf_dir):
    """The 20 most frequent part types (ties by value)."""
    return P.top_values(read_table(spark, sf_dir, "part", "p_type"), "p_type", 20)


_HIST_SQL = """WITH mm AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(24, floor((o_totalprice - lo) / (hi - lo) * 25)) END AS INTEGER)
      AS bucket FROM orders, mm WHERE o_totalprice IS NOT NULL),
c AS (SELECT bucket, count(*) AS count FROM b GROUP BY bucket)
SELECT g.bucket, lo + g.bucket * ((hi - lo) / 25) AS lower, lo + (g.bucket + 1) * ((hi - lo) / 25) AS upper,
  coalesce(c.count, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bucket FROM range(25)) g CROSS JOIN mm LEFT JOIN c USING (bucket)"""


@query("histogram_price", sql=_HIST_SQL, doubles=["lower", "upper"])
def histogram_price(spark, sf_dir):
    """25 equal-width buckets of the order price, empty buckets included."""
    return P.histogram(read_table(spark, sf_dir, "orders", "o_totalprice"), "o_totalprice", 25)


def _auto_sql(name: str, table: str, x: str) -> str:
    """Round buckets in SQL: the least of the widths 1, 2, 5 x 10^k that needs at most 25 of them."""
    return f"""(WITH v AS (SELECT CAST({x} AS DOUBLE) AS v FROM {table}), r AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
  w AS (SELECT CASE WHEN hi <= lo THEN 1.0 ELSE (SELECT min(m * pow(10, k)) FROM (VALUES (1), (2), (5)) AS m(m), range(-12, 13) AS k(k)
        WHERE m * pow(10, k) * 25 >= hi - lo AND floor(hi / (m * pow(10, k))) - floor(lo / (m * pow(10, k))) + 1 <= 25) END AS w, lo, hi FROM r),
  g AS (SELECT unnest(range(CAST(floor(lo / w) AS BIGINT), CAST(floor(hi / w) AS BIGINT) + 1)) AS bucket, w FROM w)
  SELECT '{name}' AS "column", bucket, bucket * w AS lower, (bucket + 1) * w AS upper,
         (SELECT count(*) FROM v WHERE floor(v / w) = bucket) AS count FROM g)"""


_AUTO = [("price", "lineitem", "l_extendedprice"), ("discount", "lineitem", "l_discount"), ("balance", "customer", "c_acctbal"), ("constant", "orders", "7")]


@query("histogram_auto", sql=" UNION ALL ".join(_auto_sql(*a) for a in _AUTO), doubles=["lower", "upper"])
def histogram_auto(spark, sf_dir):
    """A7, automatic bins: round buckets of prices, discounts and balances (some negative), and of a constant column."""
    out = None
    for name, table, x in _AUTO:
        h = P.auto_histogram(read_table(spark, sf_dir, table).select(F.expr(x).alias("v")), "v").select(F.lit(name).alias("column"), "*")
        out = h if out is None else out.unionByName(h)
    return out


_KDE_SQL = f"""{BASE},
s AS (SELECT count(note_moyenne) AS n, stddev_samp(note_moyenne) * pow(count(note_moyenne), -1.0 / 5.0) AS h,
        min(note_moyenne) AS lo, max(note_moyenne) AS hi FROM raw),
grid AS (SELECT CAST(range AS INTEGER) AS point, lo - 3.0 * h + range * ((hi + 3.0 * h - (lo - 3.0 * h)) / 199) AS x,
        n, h FROM s, range(200)),
v AS (SELECT note_moyenne AS v, count(*) AS w FROM raw WHERE note_moyenne IS NOT NULL GROUP BY 1)
SELECT point, x, sum(w * exp(-0.5 * pow((x - v) / h, 2))) * (1.0 / (n * h * sqrt(2.0 * pi()))) AS density
FROM grid, v GROUP BY point, x, n, h"""


@query("density_grade", sql=_KDE_SQL, doubles=["x", "density"])
def density_grade(spark, sf_dir):
    """Exact Gaussian KDE of the row-mean grade on a 200-point grid."""
    return P.density(raw_cohort(spark, sf_dir), K.TARGET_REG, 200)


def _profile_sql() -> str:
    cols = [c for c in RAW_ORDER if c not in ("id", "nom")]
    numeric = [c for c in cols if c not in COHORT_TEXT]
    kinds = _union_sql([
        f"SELECT '{c}' AS \"column\", CASE WHEN nd > 10 THEN 'histogram' ELSE 'counts' END AS kind "
        f"FROM (SELECT count(DISTINCT {c}) AS nd FROM raw)" if c in numeric else
        f"SELECT '{c}' AS \"column\", CASE WHEN nd <= 10 THEN 'counts' "
        f"ELSE '{'clock' if c in K.CLOCK_COLUMNS else 'top'}' END AS kind "
        f"FROM (SELECT count(DISTINCT {c}) AS nd FROM raw)" for c in cols])
    texts = [c for c in cols if c in COHORT_TEXT]
    counted = _union_sql([f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM raw" for c in texts])
    tops = [f"(SELECT c.\"column\", k.kind, c.value, CAST(NULL AS INTEGER) AS bucket, c.count FROM counted c "
            f"JOIN kinds k USING (\"column\") WHERE c.\"column\" = '{c}' AND k.kind = 'top' "
            f"ORDER BY c.count DESC, c.value LIMIT 20)" for c in texts]
    hists = [f"SELECT '{c}' AS \"column\", 'histogram' AS kind, CAST(NULL AS VARCHAR) AS value, "
             f"CAST(CASE WHEN hi = lo THEN 0 ELSE least(24, floor((CAST({c} AS DOUBLE) - lo) / (hi - lo) * 25)) END "
             f"AS INTEGER) AS bucket, count(*) AS count FROM raw, (SELECT CAST(min({c}) AS DOUBLE) AS lo, "
             f"CAST(max({c}) AS DOUBLE) AS hi FROM raw) mm WHERE {c} IS NOT NULL AND "
             f"(SELECT kind FROM kinds WHERE \"column\" = '{c}') = 'histogram' GROUP BY bucket" for c in numeric]
    full = ("SELECT c.\"column\", k.kind, c.value, CAST(NULL AS INTEGER) AS bucket, c.count FROM counted c "
            "JOIN kinds k USING (\"column\") WHERE k.kind IN ('counts', 'clock', 'date')")
    return (f"{BASE},\nkinds AS ({kinds}),\ncounted AS (SELECT \"column\", value, count(*) AS count FROM ({counted}) "
            f"WHERE value IS NOT NULL GROUP BY ALL)\n" + _union_sql([full] + tops + hists))


@query("profile_columns", sql=_profile_sql())
def profile_columns(spark, sf_dir):
    """Chart tables for every displayable column (counts, top 20, clock values, histograms)."""
    return P.profile(raw_cohort(spark, sf_dir))


@query("shape_cohort", sql=f"{BASE} SELECT count(*) AS n_rows, {len(RAW_ORDER)} AS n_columns FROM raw")
def shape_cohort(spark, sf_dir):
    """Rows and columns of the raw cohort."""
    return P.shape(raw_cohort(spark, sf_dir, materialize=False))


@query("first_rows", sql=f"{BASE} SELECT id, nom, classe, note_moyenne FROM raw ORDER BY id LIMIT 20",
       doubles=["note_moyenne"])
def first_rows(spark, sf_dir):
    """The first 20 students in id order (top-k, bounded per task)."""
    return preview(raw_cohort(spark, sf_dir, materialize=False), 20).select("id", "nom", "classe", "note_moyenne")


_SUBJ_SQL = f"""{PREP} """ + _union_sql([
    f"SELECT {i} AS position, '{c}' AS subject, '{X.subject_label_text(c)}' AS label, avg({c}) AS mean, "
    f"stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM feat"
    for i, c in enumerate(["note_francais", "note_maths", "note_histoire_geo", "note_sciences"])])


@query("subject_stats", sql=_SUBJ_SQL, doubles=["mean", "std", "min", "max"])
def subject_stats_q(spark, sf_dir):
    """A13 + X15: per-subject mean, sample std, min, max on the prepared cohort."""
    return subject_stats(prepared_cohort(spark, sf_dir))


@query("top_values_names",
       sql="SELECT p_name AS value, count(*) AS count FROM part WHERE p_name IS NOT NULL "
           "GROUP BY 1 ORDER BY count DESC, value LIMIT 20")
def top_values_names(spark, sf_dir):
    """A6 on a column of many values: the limit cuts, ties by value."""
    return P.top_values(read_table(spark, sf_dir, "part", "p_name"), "p_name", 20)


_PART_HIST = ("SELECT 'p_retailprice' AS \"column\", 'histogram' AS kind, CAST(NULL AS VARCHAR) AS value, "
              "CAST(CASE WHEN hi = lo THEN 0 ELSE least(24, floor((p_retailprice - lo) / (hi - lo) * 25)) END AS INTEGER) AS bucket, "
              "count(*) AS count FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) GROUP BY bucket")


@query("profile_part",
       sql="(SELECT 'p_name' AS \"column\", 'top' AS kind, p_name AS value, CAST(NULL AS INTEGER) AS bucket, count(*) AS count FROM part "
           "WHERE p_name IS NOT NULL GROUP BY p_name ORDER BY count DESC, value LIMIT 20) UNION ALL " + _PART_HIST)
def profile_part(spark, sf_dir):
    """A17, kinds 'top' and 'histogram': part names and prices."""
    return P.profile(read_table(spark, sf_dir, "part", "p_name", "p_retailprice"))


@query("profile_order_dates",
       sql="SELECT 'o_orderdate' AS \"column\", 'date' AS kind, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS value, "
           "CAST(NULL AS INTEGER) AS bucket, count(*) AS count FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL")
def profile_order_dates(spark, sf_dir):
    """A17, kind 'date': orders per day."""
    return P.profile(read_table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("o_orderdate")))


@query("motivation_of_columns",
       sql=f"{BASE} SELECT id, coalesce((coalesce(CAST(interet_maths AS DOUBLE), 0) + coalesce(heures_etude_soir, 0) + coalesce(note_francais, 0)) "
           "/ nullif(CAST(interet_maths IS NOT NULL AS INTEGER) + CAST(heures_etude_soir IS NOT NULL AS INTEGER) "
           "+ CAST(note_francais IS NOT NULL AS INTEGER), 0), 5.0) AS motivation FROM raw", doubles=["motivation"])
def motivation_of_columns(spark, sf_dir):
    """X9 over three columns, some of them NULL: the mean of the known ones, 5 when none is known."""
    raw = raw_cohort(spark, sf_dir, materialize=False)
    types = dict((f.name, f.dataType) for f in raw.schema.fields)
    cols = ["interet_maths", "heures_etude_soir", "note_francais"]
    return raw.select("id", X.motivation_index([(c, types[c]) for c in cols]).alias("motivation"))


@query("clean_drops_empty",
       sql=f"{PREP} SELECT count(*) AS n, sum(CAST(id AS BIGINT)) AS ids, {len(RAW_ORDER)} AS n_columns, false AS has_empty FROM clean")
def clean_drops_empty(spark, sf_dir):
    """A11 within C1: a column without any value is dropped, the others stay."""
    out = clean(raw_cohort(spark, sf_dir).withColumn("vide", F.lit(None).cast("double")))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("bigint")).cast("decimal(38,0)").alias("ids")) \
              .withColumns({"n_columns": F.lit(len(out.columns)), "has_empty": F.lit("vide" in out.columns)}) \
              .withColumn("ids", F.col("ids").cast("bigint"))


@query("column_steps",
       sql=f"{PREP}, s AS (SELECT * FROM (VALUES ('lowered', 'id,note_moyenne'), ('identity', 'id,nom,note_moyenne'), ('target', 'note_moyenne'), "
           "('new', 'heure_coucher_num,heure_lever_num'), ('missing', 'absences'), ('aligned', 'id,absences,heures_sommeil'), "
           "('dropped', 'nom,note_francais,note_maths,note_histoire_geo,note_sciences,heure_lever,heure_coucher,note_moyenne'), "
           "('two_classes', 'true')) AS t(step, result)) SELECT step, result, (SELECT count(*) FROM raw) AS n FROM s")
def column_steps(spark, sf_dir):
    """P1, P4, P5, P7, P8, P10, O1 and F4 on the cohort: the columns each step yields, next to the rows of its frame."""
    raw = raw_cohort(spark, sf_dir)
    upper = C.lower_names(raw.select(F.col("id").alias("ID"), F.col(K.TARGET_REG).alias("Note_Moyenne")))
    clocked = add_clock_features(raw)
    aligned = C.align_features(raw, ["absences", "heures_sommeil"], keep=["id"])
    kept = C.drop_model_columns(raw)
    steps = [("lowered", upper, upper.columns), ("identity", raw, C.identity_columns(raw, K.TARGET_REG)),
             ("target", raw, [C.default_target(raw)[0]]), ("new", clocked, C.new_columns(raw.columns, clocked.columns)),
             ("missing", raw, C.missing_features(["absences", "heures_sommeil"], raw)), ("aligned", aligned, aligned.columns),
             ("dropped", kept, [c for c in ["id", "nom", *K.GRADE_COLUMNS, "heure_lever", "heure_coucher", K.TARGET_REG] if c in raw.columns and c not in kept.columns]),
             ("two_classes", raw, [str(class_guard(raw.withColumn("p", X.pass_label(K.TARGET_REG)), "p")).lower()])]
    out = None
    for name, df, cols in steps:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("step"), F.lit(",".join(cols)).alias("result"), "n")
        out = row if out is None else out.unionByName(row)
    return out
