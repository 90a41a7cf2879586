"""Queries of adapters, evidence and record ids, with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import adapters
from ..operators import gates as G
from ..sources import files
from .queries import query, table

SEGMENT_WORDS = 8


def _segments(text: str) -> list[str]:
    words = [w for w in text.split(" ") if w]
    return [" ".join(words[i : i + SEGMENT_WORDS]) for i in range(0, len(words), SEGMENT_WORDS)]


def _lengths():
    """A deterministic model for the registered query: the number of characters of each segment."""
    return lambda segments: [str(len(s)) for s in segments]


@query("""WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[^ ]+') AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN array_to_string([length(array_to_string(w[i : i + 7], ' ')) FOR i IN range(1, len(w) + 1, 8)], ' ') END AS output FROM w""")
def adapter_outputs(spark, d):
    """Each turn's segments through a model in batches, outputs joined in order."""
    return adapters.translated(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", "output", _lengths, _segments).drop("text")


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS en, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE lang END AS vi, CASE WHEN doc_id % 13 = 0 THEN [] ELSE [source] END AS tags FROM documents)
SELECT * FROM (SELECT doc_id::VARCHAR AS row_id, CASE WHEN coalesce(trim(en), '') = '' THEN 'en' WHEN coalesce(trim(vi), '') = '' THEN 'vi' WHEN len(tags) = 0 THEN 'technical_tags' END AS problem FROM x) WHERE problem IS NOT NULL""")
def invalid_examples(spark, d):
    tags = F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    row = F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("en"), F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("lang")).alias("vi"), tags.alias("technical_tags"))
    return files.invalid_examples(files.parse_examples(table(spark, d, "documents").select(F.to_json(row).alias("value"))), True)


@query("""WITH e AS (SELECT source AS role, count(*) AS n, md5(source) AS c FROM documents GROUP BY source),
f AS (SELECT role, CASE WHEN ascii(right(role, 1)) % 3 = 0 THEN n + 1 ELSE n END AS rows_, n AS predictions, CASE WHEN ascii(right(role, 1)) % 5 = 0 THEN 'trained' ELSE 'adapted' END AS stage, c FROM e WHERE ascii(right(role, 1)) % 4 <> 0)
SELECT e.role, unnest(CASE WHEN f.role IS NULL THEN ['missing'] ELSE list_filter([CASE WHEN f.rows_ <> e.n THEN 'rows_differs' END, CASE WHEN f.stage <> 'adapted' THEN 'stage_differs' END, CASE WHEN f.predictions <> f.rows_ THEN 'predictions_differ' END], lambda v: v IS NOT NULL) END) AS problem
FROM e LEFT JOIN f ON e.role = f.role""")
def gate_evidence(spark, d):
    e = table(spark, d, "documents").groupBy(F.col("source").alias("role")).agg(F.count("*").alias("rows")).withColumn("checkpoint", F.md5("role")).withColumn("stage", F.lit("adapted"))
    last = F.ascii(F.right("role", F.lit(1)))
    f = e.filter(last % 4 != 0).select("role", (F.col("rows") + F.when(last % 3 == 0, 1).otherwise(0)).alias("rows"), F.col("rows").alias("predictions"), F.when(last % 5 == 0, "trained").otherwise("adapted").alias("stage"), "checkpoint")
    return G.evidence_problems(e, f)


@query("""SELECT * FROM (SELECT c_custkey AS id, CASE WHEN n_nationkey IS NULL THEN 'artifact_missing' WHEN CASE WHEN c_custkey % 10 = 0 THEN md5('x') ELSE md5(n_name) END <> md5(n_name) THEN 'checksum_differs' END AS problem
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 0) ON c_nationkey = n_nationkey) WHERE problem IS NOT NULL""")
def gate_checksums(spark, d):
    found = table(spark, d, "nation").filter("n_nationkey % 6 <> 0").select(F.col("n_nationkey").alias("id"), F.md5("n_name").alias("sha256"))
    said = table(spark, d, "nation").select("n_nationkey", F.md5("n_name").alias("said"))
    r = table(spark, d, "customer").join(said, F.col("c_nationkey") == F.col("n_nationkey"))
    r = r.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"), F.when(F.col("c_custkey") % 10 == 0, F.md5(F.lit("x"))).otherwise(F.col("said")).alias("said"))
    return G.checksum_problems(r, found, "id", "parent", "said")


@query("""WITH r AS (SELECT o_orderkey AS row_id, floor(o_totalprice)::BIGINT AS tokens, o_orderkey % 50 = 0 AS fixed FROM orders),
w AS (SELECT row_id FROM r WHERE tokens <= 300000 AND NOT fixed),
c AS (SELECT 'teacher' AS role, row_id FROM w WHERE row_id % 17 <> 0 UNION ALL SELECT 'student', row_id FROM r WHERE NOT fixed AND (tokens <= 300000 OR row_id % 19 = 0))
SELECT role, row_id, 'excluded_row_used' AS problem FROM c WHERE row_id NOT IN (SELECT row_id FROM w)
UNION ALL SELECT role, w.row_id, 'eligible_row_missing' FROM w, (SELECT DISTINCT role FROM c) r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.role = r.role AND c.row_id = w.row_id)""")
def gate_cohorts(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.floor("o_totalprice").alias("tokens"))
    fixed, open_ = r.filter("row_id % 50 = 0"), r.filter("row_id % 50 <> 0")
    teacher = open_.filter("tokens <= 300000 and row_id % 17 <> 0").select(F.lit("teacher").alias("role"), "row_id")
    student = open_.filter("tokens <= 300000 or row_id % 19 = 0").select(F.lit("student").alias("role"), "row_id")
    return G.cohort_problems(teacher.unionByName(student), r, fixed, 300000, ("teacher", "student"))


@query("SELECT event_id, 'c' || strftime(ts, '%Y%m%d-%H%M%S%g') || '-' || lpad(lower(to_hex((event_id * 7919) % 65536)), 4, '0') AS id FROM events")
def record_ids(spark, d):
    return table(spark, d, "events").select("event_id", T.new_id(F.col("ts"), F.col("event_id") * 7919).alias("id"))


@query("""SELECT event_id, event_id % 4 = 0 AS utc FROM events""")
def utc_stamps(spark, d):
    """Whether a stamp is in UTC: some have another offset, none, or a day that does not exist."""
    t, kind = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id") % 4
    stamp = F.when(kind == 0, F.concat(t, F.lit("+00:00"))).when(kind == 1, F.concat(t, F.lit("+07:00"))).when(kind == 2, t).otherwise(F.lit("2024-02-30T10:00:00+00:00"))
    return table(spark, d, "events").select("event_id", T.is_utc(stamp).alias("utc"))
