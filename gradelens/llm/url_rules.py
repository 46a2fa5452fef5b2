"""URL filtering by fixed rules and by mined association rules.

A url becomes a set of tokens: its host's suffixes, its path segments and its query
keys.  Urls with a label (by default the verdict of a fixed rule that fits) are
baskets of their tokens and their label.  Tokens that occur in exactly the same
labelled urls are one item: what holds with one of them holds with each, so a long
path or host costs one item and not a power of its length.  Spark's FP-growth mines the
frequent sets of items and labels from whole baskets; rules ``items -> block`` or
``items -> allow`` are kept that reach the confidence and the support and that no rule on
fewer items already gives as surely.

Rules match by an inverted index: each is posted under its rarest item, a
url meets only the rules posted under its own items, and of these the ones whose
other items it has too apply (an item is there if any of its tokens is).  The index also
counts every kept rule anew over all labelled urls.  The surest rule decides, then the
one of more support, then block; a url that no rule meets gets ``DEFAULT``.

Only distinct urls are matched, so a url that a third of the rows share is matched
once; the verdicts go back to the rows by an equi-join whose hot keys Spark may split.
The frequent sets stay in Spark.  Items that come independently of one another and are
frequent in each other's company multiply, as in any frequent-set mining: their number
is bounded by the support, not by the rows.

Defined cases: a null url or one without ``://`` has empty host and path, no tokens
and the default verdict; without labelled urls nothing is mined; a url of any length has all
its tokens; equal confidence and support on both sides decide for block; repeated rows get
equal verdicts; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelens.session import cut_lineage

#: (verdict, host, path); written ``host + path``.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT = 0.002
CONFIDENCE = 0.8
DEFAULT = "allow"

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def parse(urls: DataFrame) -> DataFrame:
    """``url`` with ``host`` and ``path``."""
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    return urls.withColumn("host", F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWERED)) \
        .withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)) \
        .withColumn("query", F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1))


def fixed_rule() -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``, or null."""
    out = None
    for verdict, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def tokens() -> Column:
    """Distinct tokens of a parsed url: host suffixes, path segments, query keys."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
                           lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.greatest(F.size(labels), F.lit(1))), ".")))
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.filter(F.split("query", "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    return F.when(F.size(labels) > 0, F.array_distinct(F.concat(suffixes, segments, keys))).otherwise(F.array().cast("array<string>"))


@dataclass
class Mined:
    """``rules``: items, verdict, confidence, support; ``items``: the item of every frequent token."""
    rules: DataFrame
    items: DataFrame


def token_classes(said: DataFrame, least: int) -> DataFrame:
    """``tok, item`` for the tokens of at least ``least`` rows (``row, tok``): tokens of exactly the same rows share an item.

    A set of rows is known by its size and two exclusive ors of 64-bit hashes of its rows.
    """
    sets = said.groupBy("tok").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit("b"))).alias("b"))
    same = Window.partitionBy("n", "a", "b")              # tokens of one url at most
    return sets.where(F.col("n") >= least).select("tok", F.min("tok").over(same).alias("item"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> Mined:
    """Rules from rows ``toks, label``; none implies another that is as sure on fewer items."""
    spark = labelled.sparkSession
    n = labelled.count()
    least = max(2, int(support * n))
    rows = cut_lineage(labelled.withColumn("row", F.monotonically_increasing_id()))
    said = rows.select("row", "label", F.explode(F.array_distinct("toks")).alias("tok"))
    items = cut_lineage(token_classes(said, least))
    baskets = cut_lineage(said.join(items, "tok").groupBy("row", "label").agg(F.collect_set("item").alias("items")))
    if baskets.isEmpty():
        return Mined(spark.createDataFrame([], "items array<string>, verdict string, confidence double, support double"), items)
    whole = baskets.select(F.concat("items", F.array(F.concat(F.lit("="), F.col("label")))).alias("items"))
    sets = cut_lineage(FPGrowth(itemsCol="items", minSupport=(least - 0.5) / baskets.count(), minConfidence=confidence).fit(whole).freqItemsets)
    label = F.filter("items", lambda x: x.startswith("="))
    rest = F.sort_array(F.filter("items", lambda x: ~x.startswith("=")))
    sets = sets.select(rest.alias("items"), F.get(label, F.lit(0)).alias("label"), "freq").where(F.size("items") > 0)
    alone = sets.where("label IS NULL").select("items", F.col("freq").alias("of"))
    rules = sets.where("label IS NOT NULL").join(alone, "items").where(F.col("freq") >= confidence * F.col("of"))
    rules = cut_lineage(rules.select("items", F.expr("substring(label, 2)").alias("verdict"), (F.col("freq") / F.col("of")).alias("confidence")))
    # a rule goes when dropping one or more of its items leaves a rule of the same verdict that is as sure
    single = rules.select(F.explode("items").alias("item"), "items", "verdict", "confidence")
    shorter = rules.select(F.get("items", F.lit(0)).alias("item"), F.col("items").alias("less"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    beaten = single.join(shorter, "item").where(
        (F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence")) & (F.size("less") < F.size("items"))
        & (F.size(F.array_except("less", "items")) == 0)).select("items", "verdict").distinct()
    kept = cut_lineage(rules.join(beaten, ["items", "verdict"], "left_anti").drop("confidence"))
    met = meets(baskets.select("row", "label", "items"), kept)
    counted = met.groupBy("need", "verdict").agg(F.count("*").alias("of"), F.count_if(F.col("label") == F.col("verdict")).alias("both"))
    counted = counted.where((F.col("both") >= least) & (F.col("both") >= confidence * F.col("of")))
    return Mined(cut_lineage(counted.select(F.col("need").alias("items"), "verdict", (F.col("both") / F.col("of")).alias("confidence"),
                                            (F.col("both") / n).alias("support"))), items)


def meets(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (with ``items``) and each rule that applies to them (its items as ``need``), by an inverted index of the rules."""
    used = rows.select(F.explode("items").alias("item")).groupBy("item").count()
    named = rules.withColumnRenamed("items", "need").select("*", F.explode("need").alias("item"))
    other = [c for c in rules.columns if c != "items"]
    posted = named.join(used, "item", "left").groupBy("need", *other).agg(F.min_by("item", F.struct(F.coalesce("count", F.lit(0)), "item")).alias("item"))
    said = rows.withColumn("item", F.explode("items"))
    return said.join(posted, "item").where(F.size(F.array_except("need", "items")) == 0).drop("item")


def match(urls: DataFrame, mined: Mined) -> DataFrame:
    """``url, mined``: the verdict of the surest rule, for rows ``url, toks``."""
    known = urls.select("url", F.explode("toks").alias("tok")).join(mined.items, "tok").groupBy("url").agg(F.collect_set("item").alias("items"))
    return meets(cut_lineage(known), mined.rules).groupBy("url").agg(F.max_by("verdict", F.struct("confidence", "support", "verdict")).alias("mined"))


def judge(pages: DataFrame, labels: Column | None = None) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict``; ``labels`` may give block or allow for the mining."""
    parsed = parse(pages.select("page_id", "url")).withColumn("_rule", fixed_rule())
    label = F.col("_rule.verdict") if labels is None else labels
    distinct = cut_lineage(parsed.where("url is not null").select("url", "host", "path", "query", "_rule").distinct().withColumn("toks", tokens()).withColumn("label", label))
    rules = mine(distinct.where(F.col("label").isNotNull() & (F.size("toks") > 0)).select("toks", "label"))
    mined = match(distinct.where(F.col("_rule").isNull()).select("url", "toks"), rules)
    ruled = parsed.where(F.col("_rule").isNotNull() | F.col("url").isNull()).withColumn("mined", F.lit(None).cast("string"))
    open_ = parsed.where(F.col("_rule").isNull() & F.col("url").isNotNull()).join(mined, "url", "left")
    cols = [F.col("page_id"), F.col("host"), F.col("path"), F.col("_rule.rule").alias("rule"),
            F.coalesce("_rule.verdict", "mined", F.lit(DEFAULT)).alias("verdict")]
    return ruled.select(*cols).unionByName(open_.select(*cols))
