"""The registered queries of the operators, and their DuckDB SQL where SQL can express them.

Each query applies its operator, with production parameters, to the whole of
its table and derives the contract's columns from the operator's output.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradelens.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on this machine (the operators take the path as a parameter)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids by multiway differencing."""
    import public_tokenizers

    from .packing import pack
    return pack(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"),
                vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op3_decontamination", sql="""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, greatest(len(ws) - size + 2, 1))) AS i FROM w, sizes)
), hits AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
n AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark windows of 10 words."""
    from .decontam import report
    return report(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document; huge documents by spliced overlapping chunks."""
    from .token_count import count
    return count(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"))


@query("op10_fingerprints", sql=None)
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of all documents and of their edited texts."""
    from .fingerprint import edit_report
    return edit_report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_substring_dedup", sql="""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS t
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS i FROM w)
), f AS (SELECT t, min(struct_pack(d := doc_id, i := i)) AS first FROM win GROUP BY t HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos
  FROM win JOIN f USING (t) WHERE struct_pack(d := doc_id, i := i) > first
), words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(coalesce((SELECT count(*) FROM gone WHERE gone.doc_id = w.doc_id), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of passages of 20 words or more that occurred earlier."""
    from .substrings import deduplicate
    return deduplicate(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op6_near_duplicates", sql="""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (
  WITH RECURSIVE reach(doc_id, other) AS (SELECT a, b FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.other = e.a)
  SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(r.least, w.doc_id)) AS component_id,
       least(w.doc_id, coalesce(r.least, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
""")
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents whose 5-word shingle sets are alike to 85 % or more."""
    from .near_dup import classes
    return classes(read_table(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document; learned from labelled documents that are not held out."""
    from .toxicity import report
    return report(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "toxic"))


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document; learned from all documents that are not held out."""
    from .language import report
    return report(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: base patterns and the spans that the network adds."""
    from .pii import report
    return report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url: the fixed rules, else mined association rules."""
    from .url_rules import judge
    return judge(read_table(spark, sf_dir, "pages", "page_id", "url"))


@query("op11_lm_score")
def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a hidden Markov language model of those that are not held out."""
    from .hidden_markov import report
    return report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of two tokenizers aligned in every whole document, with corpus counts of the linked pairs."""
    import public_tokenizers

    from .token_align import report
    return report(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), public_tokenizers.PATTERN)


@query("op13_filter_audit", sql="""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t
), lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(ws) < 50)::INT AS fa, (100 * len(list_distinct(ws)) < 65 * len(ws))::INT AS fb,
         (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT AS fc,
         regexp_matches(text, '[#$%&*|]')::INT AS fd, coalesce(w.doc_id > first, false)::INT AS fe
  FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id
), m AS (
  SELECT part, fa + 2 * fb + 4 * fc + 8 * fd + 16 * fe AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL
), o(filter_order, step, f, earlier) AS (
  SELECT '', 0, 0, 0
  UNION ALL
  SELECT filter_order || substr('ABCDE', i + 1, 1), step + 1, i, earlier + CASE WHEN step = 0 THEN 0 ELSE 1 << f END
  FROM o, (SELECT unnest(range(0, 5))::INT AS i) WHERE step < 5 AND NOT contains(filter_order, substr('ABCDE', i + 1, 1))
), steps AS (
  SELECT p.filter_order, o.step, o.f, o.earlier FROM o JOIN o p ON p.step = 5 AND o.step > 0 AND starts_with(p.filter_order, o.filter_order)
), s AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN mask & (earlier | (1 << f)) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & (1 << f) > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & (1 << f) > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = 1 << f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & (1 << f) > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & (1 << f) > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM s
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, per source."""
    from .filter_audit import audit
    return audit(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"), read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
