"""CSV source and sink (S1, S2) with the reference's conventions.

Reading: the separator is the one that cuts the first lines into records of the
most constant number of fields (quotes respected; one small read), every column
is read as text, pandas' missing-value tokens become NULL, names
are lower-cased (and a UTF-8 BOM removed), then column types are inferred
with ONE aggregation over all columns (integer -> bigint, number -> double,
True/False -> boolean, otherwise text).  A line break inside quotes is a part of
its value: one pass over the lines looks for unpaired quotes, and only files that
have some are read record by record (which Spark can't split within a file).
Writing: ';' separator, header, quotes doubled, UTF-8 with a BOM in front of the
header (Spark writes one file per task).
"""
from __future__ import annotations

import csv
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import NUMERIC_TEXT
from ..operators.columns import lower_names, nan_to_null

log = logging.getLogger(__name__)

SEPARATORS = [";", ",", "\t", "|"]
#: First lines that the separator is detected from.
SNIFF_LINES = 200
BOM = "﻿"
# Text read as missing by pandas' CSV reader (its default list).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def _field_counts(lines: list[str], sep: str) -> list[int]:
    """Fields of each record that ``sep`` makes of the lines; blank lines are none."""
    counts = []
    try:
        for record in csv.reader((line + "\n" for line in lines), delimiter=sep):
            if record:
                counts.append(len(record))
    except csv.Error:                                   # a field over the parser's limit: judge by the records before it
        pass
    return counts


def detect_separator(text: str) -> str:
    """The separator of the header and the lines after it; a comma when no candidate occurs.

    A candidate must cut the header.  It scores by the share of records that have as
    many fields as the header, then by that number; earlier candidates win ties.
    """
    lines = text.split("\n")

    def score(sep: str) -> tuple[float, int]:
        counts = _field_counts(lines, sep)
        if not counts or counts[0] < 2:
            return 0.0, 0
        return sum(n == counts[0] for n in counts) / len(counts), counts[0]

    best = max(SEPARATORS, key=score)
    return best if score(best)[1] else ","


def quotes_span_lines(lines: DataFrame) -> bool:
    """Whether a line of a text scan holds an odd number of quotes, as a quoted line break leaves."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return bool(lines.agg(F.bool_or(quotes % 2 == 1).alias("odd")).first()["odd"])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to bigint / double / boolean when every value allows it."""
    aggs = []
    for i, c in enumerate(df.columns):
        v = F.col(c)
        aggs += [F.count_if(v.isNotNull() & ~v.rlike(INTEGER_TEXT)).alias(f"i{i}"),
                 F.count_if(v.isNotNull() & ~v.rlike(NUMERIC_TEXT)).alias(f"n{i}"),
                 F.count_if(v.isNotNull() & ~F.lower(v).isin("true", "false")).alias(f"b{i}"),
                 F.count(v).alias(f"c{i}")]
    r = df.agg(*aggs).first()
    cols = []
    for i, c in enumerate(df.columns):
        v = F.trim(F.col(c))
        if r[f"c{i}"] == 0:
            cols.append(F.col(c).cast("double").alias(c))      # an all-missing column is float in pandas
        elif r[f"i{i}"] == 0:
            cols.append(v.try_cast("bigint").alias(c))
        elif r[f"n{i}"] == 0:
            cols.append(v.try_cast("double").alias(c))
        elif r[f"b{i}"] == 0:
            cols.append((F.lower(F.col(c)) == "true").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def read_table_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """CSV with detected separator, lower-case names, NA tokens as NULL; None on error."""
    try:
        lines = spark.read.text(path)
        first = [r["value"] for r in lines.limit(SNIFF_LINES).collect()]
        if not first:
            raise ValueError("empty file")
        sep = detect_separator("\n".join(first).lstrip(BOM))
        raw = (spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").option("escape", '"')
               .option("multiLine", quotes_span_lines(lines)).option("inferSchema", False).csv(path))
        raw = raw.toDF(*[c.lstrip(BOM) for c in raw.columns])
        raw = lower_names(raw)
        tokens = F.array(*[F.lit(t) for t in NA_TOKENS])
        raw = raw.select(*[F.when(F.array_contains(tokens, F.col(c)), F.lit(None).cast("string"))
                            .otherwise(F.col(c)).alias(c) for c in raw.columns])
        return nan_to_null(infer_types(raw))
    except Exception as ex:  # noqa: BLE001 - the reference returns None on any error
        log.error("cannot load %s: %s", path, ex)
        return None


def write_table_csv(df: DataFrame, path: str, sep: str = ";", bom: bool = True) -> None:
    """S2: ';'-separated CSV with header, UTF-8, BOM before the header."""
    out = df
    if bom and df.columns:
        out = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    out.write.mode("overwrite").option("sep", sep).option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
