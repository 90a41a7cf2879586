"""The registered queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, licences, mixing, pii, quality_model, quality_rules, substring_dedup, token_counts, url_filters

#: Vocabulary of op4; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    total = F.size("found").cast("long")
    return found.select("doc_id", *map(count, pii.BASE), "base_sha256", spans.alias("spans"), total.alias("n_spans"), *map(count, pii.KINDS[4:]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.summary(substring_dedup.passages(table(spark, sf_dir, "documents")))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = quality_rules.judge(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "left_words")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_pii, op3_quality, op4_tokens, op5_licences, op6_jaccard, op7_urls, op8_decontamination, op9_passages, op10_rules, pipeline)}

_SQL_OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w,
         (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total
  FROM per),
rated AS (
  SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS rate
  FROM ranked WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT min_by(rate, cap / w) AS lam FROM rated WHERE cap >= rate * w),
targets AS (
  SELECT source, source_size, CASE WHEN cap >= rate * w THEN lam * w ELSE cap END AS target FROM rated, final),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
sums AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS own
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN up_to - budget <= budget - (up_to - own) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sums
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CLASSES = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS s
  FROM words WHERE len(w) > 0),
nodes AS (SELECT min(doc_id) AS node, count(*) AS copies, any_value(len(s)) AS n, s FROM sets GROUP BY s),
member AS (SELECT doc_id, n.node, n.copies FROM sets JOIN nodes n ON sets.s = n.s),
grams AS (SELECT node, n, unnest(s) AS g FROM nodes),
links AS (
  SELECT a.node AS a, b.node AS b FROM grams a JOIN grams b ON a.g = b.g AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS node, least(a, min(b)) AS class_id FROM reach GROUP BY a),
degree AS (SELECT l.a AS node, sum(n.copies) AS links FROM links l JOIN nodes n ON n.node = l.b GROUP BY l.a),
classes AS (
SELECT d.doc_id, coalesce(c.class_id, m.node, d.doc_id) AS class_id, (coalesce(m.copies - 1, 0) + coalesce(g.links, 0))::BIGINT AS n_links
FROM documents d LEFT JOIN member m ON d.doc_id = m.doc_id LEFT JOIN class c ON c.node = m.node LEFT JOIN degree g ON g.node = m.node)
"""

_SQL_OP6 = f"{_CLASSES} SELECT doc_id, class_id, n_links FROM classes"

_SQL_OP8 = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item, unnest([array_to_string(w[i : i + 9], ' ') FOR i IN range(1, greatest(2, len(w) - 8))]) AS p, least(len(w), 10) AS n
  FROM items WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM phrases),
windows AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, sizes WHERE len(w) >= n),
occ AS (SELECT v.doc_id, v.i, v.n, p.item FROM windows v JOIN phrases p ON p.n = v.n AND p.p = array_to_string(v.w[v.i : v.i + v.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_SQL_OP10 = _CLASSES + r""",
d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM again) GROUP BY doc_id),
raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         md5(array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ')) AS h
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
ident AS (SELECT doc_id, source, class_id AS ident FROM (SELECT DISTINCT doc_id, source FROM lines) JOIN classes USING (doc_id)),
hosts AS (SELECT source, count(DISTINCT ident) AS n FROM ident GROUP BY source),
often AS (
  SELECT l.source, l.h, count(DISTINCT i.ident) AS n FROM lines l JOIN ident i ON l.doc_id = i.doc_id GROUP BY l.source, l.h),
gone AS (
  SELECT l.doc_id, sum(l.n) AS removed FROM lines l JOIN often o ON l.h = o.h AND l.source IS NOT DISTINCT FROM o.source
  JOIN hosts t ON t.source IS NOT DISTINCT FROM o.source WHERE o.n > 20 AND o.n > 0.05 * t.n GROUP BY l.doc_id),
c AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, gone.removed
  FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (n_words - coalesce(removed, 0))::BIGINT AS left_words FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_words,
       NOT base_failed AND NOT (removed IS NOT NULL AND (left_words < 10 OR left_words < 0.2 * n_words)) AS kept
FROM f
"""

ORACLE = {"op1_mixing": _SQL_OP1, "op6_jaccard": _SQL_OP6, "op8_decontamination": _SQL_OP8, "op10_rules": _SQL_OP10}
