"""Row expressions (X1-X20) as native Column builders.

Every function returns a ``pyspark.sql.Column`` built from built-in functions,
so it stays inside whole-stage codegen; there is no Python UDF here.
NULL plays the role of pandas' NaN throughout (NaN is turned into NULL at
ingest, see ``operators.columns.nan_to_null``).
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K

# Text accepted as a number: optional sign, digits with optional fraction or a
# bare fraction, optional exponent, surrounding blanks.  Guards ``try_cast``,
# which would otherwise read '3d' as 3.0.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_to_double(c) -> Column:
    """Guarded text -> double: NULL unless the whole text is a number."""
    s = F.trim(_col(c).cast("string"))
    return F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))


def to_number(c, dtype: T.DataType | None = None) -> Column:
    """Numeric coercion; bad text -> NULL; booleans count as 0/1."""
    c = _col(c)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    return text_to_double(c)


def parse_clock(c) -> Column:
    """X1: '22h30' / '22:30' -> 22.5 hours; anything unparsable -> 0.0.

    Lower-case, every 'h' becomes ':'; with a ':' the value is
    part1 + part2/60 (blank part2 = 0, further parts ignored); otherwise the
    whole text as a number.  NULL -> 0.0.
    """
    s = F.translate(F.lower(_col(c).cast("string")), "h", ":")
    first = F.split_part(s, F.lit(":"), F.lit(1))
    second = F.split_part(s, F.lit(":"), F.lit(2))
    minutes = F.when(second == "", F.lit(0.0)).otherwise(text_to_double(second))
    value = F.when(F.instr(s, ":") > 0, text_to_double(first) + minutes / F.lit(60.0)) \
             .otherwise(text_to_double(s))
    return F.coalesce(value, F.lit(0.0))


def truthy(c) -> Column:
    """1 if the lower-cased text is one of oui/yes/1/true, else 0."""
    return F.coalesce(F.lower(_col(c).cast("string")).isin(K.TRUTHY_TEXT).cast("int"), F.lit(0))


def row_sum(cols: Iterable) -> Column:
    """Sum with NULL as 0; duplicates in ``cols`` are added again."""
    cols = [_col(c) for c in cols]
    if not cols:
        return F.lit(0)
    total = F.coalesce(cols[0], F.lit(0))
    for c in cols[1:]:
        total = total + F.coalesce(c, F.lit(0))
    return total


def row_mean(cols: Iterable) -> Column:
    """Mean of the non-NULL values of ``cols``; NULL when none."""
    cols = [_col(c) for c in cols]
    if not cols:
        return F.lit(None).cast("double")
    num = row_sum(c.cast("double") for c in cols)
    den = row_sum(c.isNotNull().cast("int") for c in cols)
    return F.try_divide(num, den)


def balance_score(sleep, sport, screens, study) -> Column:
    """(sleep + 2*sport) / (screens + study + 1); NULL propagates."""
    return F.try_divide(_col(sleep) + _col(sport) * F.lit(2), _col(screens) + _col(study) + F.lit(1))


def study_ratio(study, screens) -> Column:
    """Study / (screens + 0.5)."""
    return F.try_divide(_col(study), _col(screens) + F.lit(0.5))


def stress_number(c, dtype: T.DataType | None = None) -> Column:
    """Numeric stress, bad text and NULL -> 0."""
    return F.coalesce(to_number(c, dtype), F.lit(0.0))


def motivation_index(cols_with_types: Iterable[tuple]) -> Column:
    """Mean of the numeric values of the interest columns; NULL -> 5.0."""
    nums = [to_number(c, t) for c, t in cols_with_types]
    if not nums:
        return F.lit(K.DEFAULT_MOTIVATION)
    return F.coalesce(row_mean(nums), F.lit(K.DEFAULT_MOTIVATION))


def pass_label(note, threshold: float = K.PASS_THRESHOLD) -> Column:
    """Note >= threshold as 0/1; NULL -> 0."""
    return F.coalesce((_col(note) >= F.lit(threshold)), F.lit(False)).cast("int")


def clip(c, lo: float = K.GRADE_MIN, hi: float = K.GRADE_MAX) -> Column:
    """np.clip that keeps NULL (Spark's greatest/least would skip it)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def map_literal(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def recode(c, mapping: Mapping[str, str] = K.CLASS_CODES) -> Column:
    """Known full names -> codes; unknown values unchanged."""
    return F.coalesce(F.try_element_at(map_literal(mapping), _col(c)), _col(c))


def translate_name(c, mapping: Mapping[str, str] = K.TRANSLATIONS) -> Column:
    """Readable label of a feature name, or the name itself."""
    return recode(c, mapping)


def band(pred) -> Column:
    """X13: 'green' from 14, 'orange' from 10, else 'red'."""
    p = _col(pred)
    return F.when(p >= K.BAND_GREEN_FROM, "green").when(p >= K.BAND_ORANGE_FROM, "orange") \
            .when(p.isNotNull(), "red")


def gap(pred, actual) -> Column:
    """Predicted - actual."""
    return _col(pred) - _col(actual)


def subject_label_text(name: str) -> str:
    """X15 on a name: drop 'note_' and capitalise (first upper, rest lower)."""
    return name.replace("note_", "").capitalize()


def subject_label(c) -> Column:
    """X15 on data: same rule as ``subject_label_text``."""
    s = F.replace(_col(c), F.lit("note_"), F.lit(""))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def format_clock(hours, minutes) -> Column:
    """Zero-padded HH:MM."""
    return F.concat(F.lpad(_col(hours).cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(_col(minutes).cast("string"), 2, "0"))


def percent(part, total) -> Column:
    """Part / total * 100, 0 for an empty total."""
    return F.coalesce(F.try_divide(_col(part).cast("double") * F.lit(100.0), _col(total)), F.lit(0.0))


def interaction(a, b) -> Column:
    """Product of two features (documented-only in the reference)."""
    return _col(a) * _col(b)


def at_risk(proba, pred) -> Column:
    """Pass probability below 60 % or predicted grade below 10."""
    return (_col(proba) < F.lit(K.AT_RISK_PROBA)) | (_col(pred) < F.lit(K.PASS_THRESHOLD))
