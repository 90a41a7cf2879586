"""Registered queries over the driver tables, each with SQL of the same meaning where SQL has one.

`pairs` are the first two lines of documents as a parallel text of five sources; `replies` are user turns with the
assistant's next turn; `runs` are three models' outputs over shared rows, taken from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as Q
from ..functions import text as T
from ..operators import metrics, pairs as P
from ..streaming import conversation, endpointing

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pairs(spark, d) -> DataFrame:
    """Each user's turn of a conversation with the answer to it, in whole; the row index tells conversation and turn."""
    t = table(spark, d, "conversations")
    asked = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("en"))
    answer = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("vi"))
    category = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.col("conv_id") % 4 + 1).cast("int"))
    row = F.col("conv_id") * 1_000_000 + F.col("turn")
    return asked.join(answer, ["conv_id", "turn"], "left").select(F.concat(F.lit("s"), F.col("conv_id") % 5).alias("source_short_name"), row.alias("raw_row_index"), "en", "vi", category.alias("category"))


def replies(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    u = t.filter("role = 'user'").select("conv_id", F.col("turn").alias("turn"), F.col("text").alias("reference"))
    a = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return u.join(a, ["conv_id", "turn"]).withColumn("row_id", F.concat_ws(":", "conv_id", "turn"))


def runs(spark, d) -> DataFrame:
    """(row_id, model, value, part): one row for each model of a row."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.concat(F.lit("m"), "l_linenumber").alias("model"), F.col("l_quantity").alias("value"), F.col("l_partkey").alias("part"))


_PAIRS = """pairs AS (SELECT 's' || (u.conv_id % 5) AS source_short_name, u.conv_id * 1000000 + u.turn AS raw_row_index, u.text AS en, a.text AS vi,
  ['de', 'en', 'es', 'fr'][u.conv_id % 4 + 1] AS category
  FROM (SELECT * FROM conversations WHERE role = 'user') u LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
"""
_B = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_C = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"


def _clean(c: str) -> str:
    return f"regexp_replace(regexp_replace(nfc_normalize({c}), '{_B}+', ' ', 'g'), '^ | $', '', 'g')"


def _key(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def _bounded(p: str) -> str:
    """A Java pattern's word bounds for an engine whose own are ASCII: existence of a match is the same."""
    return p.replace("'", "''").replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])")


_VALID = _PAIRS + f"""valid AS (SELECT *, {_clean('en')} AS en_clean, {_clean('vi')} AS vi_clean FROM pairs
  WHERE en IS NOT NULL AND vi IS NOT NULL AND NOT regexp_matches(en || vi, '{_C}') AND NOT contains(en || vi, '�')),
ok AS (SELECT * FROM valid WHERE en_clean <> '' AND vi_clean <> ''),
once AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY source_short_name, en_clean, vi_clean ORDER BY raw_row_index) = 1),
keyed AS (SELECT *, {_key('en_clean')} AS en_key, {_key('vi_clean')} AS vi_key FROM once),
copies AS (SELECT *, en_key || '␟' || vi_key AS global_key, sha256(en_key) AS leakage_group_id,
  row_number() OVER (PARTITION BY en_key, vi_key ORDER BY source_short_name, raw_row_index) AS copy FROM keyed)
"""


def _tag(name: str) -> str:
    flag = "" if name in T.CASE_SENSITIVE_TAGS else "(?i)"
    return f"regexp_matches(en_clean || chr(10) || vi_clean, '{flag}{_bounded(T.TAG_PATTERNS[name])}')"


_TAGGED = _VALID + ", tagged AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {_tag(k)} THEN '{k}' END" for k in T.TAG_PATTERNS) + "], lambda x: x IS NOT NULL) AS tags FROM copies)"
_GROUPED = _TAGGED + f""", grouped AS (SELECT *, CASE WHEN list_contains(tags, 'has_command') THEN '{T.GROUPS[0]}' WHEN list_contains(tags, 'has_ui') THEN '{T.GROUPS[1]}'
  WHEN list_contains(tags, 'has_error') OR regexp_matches(en_clean || ' ' || vi_clean, '(?i){_bounded(T.GUIDE_PATTERN)}') THEN '{T.GROUPS[2]}' ELSE '{T.GROUPS[3]}' END AS primary_group,
  CASE WHEN len(tags) > 0 OR regexp_matches(en_clean || ' ' || vi_clean, '(?i){_bounded(T.GUIDE_PATTERN)}') THEN 'rule_based' ELSE 'default_group' END AS group_method FROM tagged)"""
_SPLIT = _GROUPED + """, kept AS (SELECT * FROM grouped WHERE copy = 1),
reps AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY leakage_group_id ORDER BY source_short_name, raw_row_index) = 1),
placed AS (SELECT leakage_group_id, row_number() OVER (PARTITION BY source_short_name, primary_group ORDER BY substr(sha256('42:' || leakage_group_id), 1, 16), leakage_group_id) - 1 AS i,
  count(*) OVER (PARTITION BY source_short_name, primary_group) AS n FROM reps),
assigned AS (SELECT leakage_group_id, CASE WHEN i < greatest(1, round_even(n * 0.8, 0)) THEN 'train' WHEN i < greatest(1, round_even(n * 0.9, 0)) THEN 'validation' ELSE 'it_test' END AS split FROM placed)
"""


# --- scans, projections, filters ---------------------------------------------------------------------------------------


@query("SELECT 'a' AS source_short_name, doc_id AS raw_row_index, text AS en, lang AS vi, source AS category FROM documents UNION ALL SELECT 'b', conv_id, text, role, NULL FROM conversations")
def scan_mapped_sources(spark, d):
    a = P.mapped(table(spark, d, "documents"), "a", "text", "lang", "doc_id", "source")
    return P.union_all([a, P.mapped(table(spark, d, "conversations"), "b", "text", "role", "conv_id")])


@query("SELECT doc_id::VARCHAR AS row_id, text AS en, lang AS vi, [source] AS technical_tags FROM documents")
def jsonl_alias_scan(spark, d):
    lines = table(spark, d, "documents").select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("en_clean"), F.when(F.col("doc_id") % 2 == 1, F.col("text")).alias("en"), F.col("lang").alias("vi"), F.array("source").alias("technical_tags"))).alias("value"))
    from ..sources.files import parse_examples

    return parse_examples(lines)


@query("WITH " + _PAIRS + f"""x AS (SELECT {_key(_clean('en'))} AS en_key, {_key(_clean('vi'))} AS vi_key FROM pairs WHERE en IS NOT NULL AND vi IS NOT NULL AND category = 'en'),
y AS (SELECT {_key(_clean('text'))} AS en_key, {_key(_clean('text'))} AS vi_key FROM benchmark WHERE text IS NOT NULL) SELECT * FROM x UNION SELECT * FROM y""")
def protected_pairs(spark, d):
    """Keys of the protected sets: the pairs of one category and the benchmark's items as pairs of themselves."""
    x = pairs(spark, d).filter("en is not null and vi is not null and category = 'en'").select("en", "vi")
    y = table(spark, d, "benchmark").filter("text is not null").select(F.col("text").alias("en"), F.col("text").alias("vi"))
    return x.union(y).select(T.match_key(T.clean(F.col("en"))).alias("en_key"), T.match_key(T.clean(F.col("vi"))).alias("vi_key")).distinct()


@query("WITH " + _VALID + "SELECT source_short_name, raw_row_index, en_clean, vi_clean FROM ok")
def valid_pairs(spark, d):
    return P.valid(pairs(spark, d)).select("source_short_name", "raw_row_index", "en_clean", "vi_clean")


@query("WITH " + _VALID + "SELECT source_short_name, raw_row_index, category FROM once WHERE source_short_name <> 's1' OR category IN ('en', 'de')")
def category_after_dedup(spark, d):
    return P.cleaned(pairs(spark, d), {"s1": ["en", "de"]}).select("source_short_name", "raw_row_index", "category")


@query("WITH " + _PAIRS.rstrip(",\n") + " SELECT raw_row_index, dir AS direction, CASE WHEN dir = 'en_to_vi' THEN en ELSE vi END AS source, CASE WHEN dir = 'en_to_vi' THEN vi ELSE en END AS target FROM pairs, (VALUES ('en_to_vi'), ('vi_to_en')) v(dir)")
def direction_swap(spark, d):
    x = pairs(spark, d).withColumn("direction", F.explode(F.array(F.lit("en_to_vi"), F.lit("vi_to_en"))))
    forward = F.col("direction") == "en_to_vi"
    return x.select("raw_row_index", "direction", F.when(forward, F.col("en")).otherwise(F.col("vi")).alias("source"), F.when(forward, F.col("vi")).otherwise(F.col("en")).alias("target"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0)")
def exclusion_anti_join(spark, d):
    excluded = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(excluded, "o_custkey", "left_anti")


@query("WITH " + _TAGGED + " SELECT source_short_name, raw_row_index, len(tags)::INT AS n_tags FROM tagged WHERE len(tags) > 0 AND list_has_any(tags, ['has_path', 'has_command', 'has_error'])")
def tagged_overlap(spark, d):
    x = P.described(P.cleaned(pairs(spark, d)))
    wanted = F.array(*map(F.lit, ("has_path", "has_command", "has_error")))
    return x.filter((F.size("technical_tags") > 0) & F.arrays_overlap("technical_tags", wanted)).select("source_short_name", "raw_row_index", F.size("technical_tags").alias("n_tags"))


@query("SELECT conv_id, turn, len(string_split_regex(text, ' +'))::INT AS words FROM conversations WHERE len(string_split_regex(text, ' +')) BETWEEN 3 AND 60")
def word_count_between(spark, d):
    n = F.size(F.split("text", " +"))
    return table(spark, d, "conversations").select("conv_id", "turn", n.alias("words")).filter("words between 3 and 60")


@query("WITH " + _PAIRS + "r AS (SELECT raw_row_index, length(en) / greatest(length(vi), 1) AS ratio FROM pairs WHERE en IS NOT NULL AND vi IS NOT NULL) SELECT raw_row_index, ratio, CASE WHEN ratio > 3.5 THEN 'en longer' ELSE 'vi longer' END AS label, round(ratio * 100, 1)::VARCHAR || '%' AS percent FROM r WHERE ratio > 3.5 OR ratio < 1 / 3.5")
def ratio_report(spark, d):
    x = pairs(spark, d).filter("en is not null and vi is not null").select("raw_row_index", T.length_ratio(F.col("en"), F.col("vi")).alias("ratio"))
    return x.filter((F.col("ratio") > 3.5) | (F.col("ratio") < 1 / 3.5)).select("raw_row_index", "ratio", F.when(F.col("ratio") > 3.5, "en longer").otherwise("vi longer").alias("label"), F.concat(F.round(F.col("ratio") * 100, 1).cast("string"), F.lit("%")).alias("percent"))


@query("SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS not_accepted FROM lineitem GROUP BY 1")
def accepted_values(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("l_returnflag").isin("A", "N")).alias("not_accepted"))


@query("SELECT page_id FROM pages WHERE contains(lower(url), '/fr/') OR contains(lower(url), 'pills') OR contains(lower(url), 'utm_')")
def forbidden_paths(spark, d):
    u = F.lower("url")
    return table(spark, d, "pages").filter(u.contains("/fr/") | u.contains("pills") | u.contains("utm_")).select("page_id")


@query("SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS ok, regexp_matches(p_brand, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS brand_ok FROM part")
def identifier_check(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_name").rlike(T.IDENTIFIER).alias("ok"), F.col("p_brand").rlike(T.IDENTIFIER).alias("brand_ok"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a/..' ELSE 'a' END) AS path FROM pages)
SELECT page_id, path <> '' AND NOT starts_with(path, '/') AND NOT contains(path, '\\') AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe FROM p""")
def safe_paths(spark, d):
    head = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "a/..").otherwise("a")
    path = F.concat(head, F.regexp_replace("url", "^[a-z]+://[^/]*", ""))
    return table(spark, d, "pages").select("page_id", path.alias("path")).select("page_id", T.safe_relative_path(F.col("path")).alias("safe"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS n_keys FROM events")
def drop_null_keys(spark, d):
    m = F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.when(F.col("user_id") % 2 == 0, F.col("event_type")))
    return table(spark, d, "events").select("event_id", F.size(F.map_filter(m, lambda k, v: v.isNotNull())).alias("n_keys"))


@query("SELECT o_orderstatus, min(o_orderkey) AS first_error FROM orders WHERE o_totalprice < 50000 OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1")
def schema_domain_errors(spark, d):
    bad = (F.col("o_totalprice") < 50000) | ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    return table(spark, d, "orders").filter(bad).groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("first_error"))


@query("SELECT l_shipmode, l_linestatus FROM (SELECT l_returnflag AS l_shipmode, l_linestatus FROM lineitem) WHERE l_shipmode = 'A' AND l_linestatus = 'F'")
def equality_filter_none(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("l_shipmode"), "l_linestatus")
    return x.filter((F.col("l_shipmode") == "A") & (F.col("l_linestatus") == "F"))


# --- joins ---------------------------------------------------------------------------------------------------------------

_LAST = "last AS (SELECT * FROM (SELECT l_orderkey AS row_id, l_partkey AS prediction, l_linenumber AS part_no FROM lineitem) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY part_no DESC, prediction DESC) = 1)"


@query(f"WITH {_LAST} SELECT o.o_orderkey AS row_id, l.prediction, l.prediction IS NULL AS missing FROM orders o LEFT JOIN last l ON l.row_id = o.o_orderkey")
def id_join_last_wins(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("prediction"), F.col("l_linenumber").alias("part_no"))
    last = x.groupBy("row_id").agg(F.max(F.struct("part_no", "prediction")).alias("m")).select("row_id", "m.prediction")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id")).join(last, "row_id", "left").withColumn("missing", F.col("prediction").isNull())


@query("SELECT o.o_orderkey, c.c_name, n.n_name, o.o_custkey <> c.c_custkey AS differs FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey")
def three_way_join(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    j = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("o_orderkey", "c_name", "n_name", (F.col("o_custkey") != F.col("c_custkey")).alias("differs"))


_RUNS = "runs AS (SELECT l_orderkey AS row_id, 'm' || l_linenumber AS model, l_quantity AS value, l_partkey AS part FROM lineitem)"


@query(f"WITH {_RUNS} SELECT row_id, max(value) FILTER (model = 'm1') AS m1, max(value) FILTER (model = 'm2') AS m2, max(value) FILTER (model = 'm3') AS m3 FROM runs GROUP BY row_id HAVING m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL")
def pivot_models(spark, d):
    return runs(spark, d).groupBy("row_id").pivot("model", ["m1", "m2", "m3"]).agg(F.max("value")).dropna()


@query(f"WITH {_RUNS}, s AS (SELECT model, part % 10 AS dataset, avg(value) AS score FROM runs GROUP BY 1, 2) SELECT a.model, a.dataset, round(a.score, 6) AS adapted, round(b.score, 6) AS pretrained, round(a.score - b.score, 6) AS delta FROM s a LEFT JOIN s b ON b.dataset = a.dataset AND b.model = 'm1' AND a.dataset <> 3")
def left_join_delta(spark, d):
    s = runs(spark, d).groupBy("model", (F.col("part") % 10).alias("dataset")).agg(F.avg("value").alias("score"))
    base = s.filter("model = 'm1' and dataset <> 3").select("dataset", F.col("score").alias("base"))
    return s.join(base, "dataset", "left").select("model", "dataset", F.round("score", 6).alias("adapted"), F.round("base", 6).alias("pretrained"), F.round(F.col("score") - F.col("base"), 6).alias("delta"))


@query("""WITH a AS (SELECT c_custkey AS id, c_nationkey AS t FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE c_nationkey END AS t FROM customer WHERE c_custkey % 5 <> 0)
SELECT count(*) FILTER (b.id IS NULL) AS missing, count(*) FILTER (a.id IS NULL) AS unexpected, count(*) FILTER (a.t <> b.t) AS differs FROM a FULL JOIN b ON a.id = b.id""")
def full_coverage(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("t"))
    a = c.filter("id % 7 <> 0").select(F.col("id").alias("a_id"), F.col("t").alias("a_t"))
    b = c.filter("id % 5 <> 0").select(F.col("id").alias("b_id"), F.when(F.col("id") % 11 == 0, -1).otherwise(F.col("t")).alias("b_t"))
    j = a.join(b, F.col("a_id") == F.col("b_id"), "full_outer")
    return j.agg(F.count_if(F.col("b_id").isNull()).alias("missing"), F.count_if(F.col("a_id").isNull()).alias("unexpected"), F.count_if(F.col("a_t") != F.col("b_t")).alias("differs"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cohort_semi_join(spark, d):
    cohort = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(cohort, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


_INTEGRITY = """
WITH expected AS (SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 9 <> 0),
target AS (SELECT doc_id AS id, md5(CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END) AS h, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE text END AS t FROM documents WHERE doc_id % 8 <> 0
  UNION ALL SELECT doc_id, md5(text), 'x' FROM documents WHERE doc_id % 50 = 1),
one AS (SELECT id, count(*) AS n, max(h) AS h1, min(h) AS h0, bool_or(trim(t) = '') AS blank, max(length(t)) AS len FROM target GROUP BY id)
SELECT count(*) FILTER (o.id IS NULL) AS missing, count(*) FILTER (o.n > 1) AS duplicate, count(*) FILTER (e.id IS NULL) AS unexpected,
 count(*) FILTER (e.id IS NOT NULL AND (o.h1 <> e.h OR o.h0 <> e.h)) AS hash_mismatch, count(*) FILTER (o.blank) AS empty, count(*) FILTER (o.len > 250) AS over_limit
FROM expected e FULL JOIN one o ON o.id = e.id"""


@query(_INTEGRITY)
def target_integrity(spark, d):
    t = table(spark, d, "documents")
    expected = t.filter("doc_id % 9 <> 0").select(F.col("doc_id").alias("e_id"), F.md5(F.col("text").cast("binary")).alias("h"))
    target = t.filter("doc_id % 8 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text")).cast("binary")).alias("h"), F.when(F.col("doc_id") % 17 == 0, " ").otherwise(F.col("text")).alias("t"))
    target = target.unionAll(t.filter("doc_id % 50 = 1").select("doc_id", F.md5(F.col("text").cast("binary")), F.lit("x")))
    one = target.groupBy(F.col("doc_id").alias("o_id")).agg(F.count("*").alias("n"), F.max("h").alias("h1"), F.min("h").alias("h0"), F.bool_or(F.trim("t") == "").alias("blank"), F.max(F.length("t")).alias("len"))
    j = expected.join(one, F.col("e_id") == F.col("o_id"), "full_outer")
    return j.agg(
        F.count_if(F.col("o_id").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("duplicate"), F.count_if(F.col("e_id").isNull()).alias("unexpected"),
        F.count_if(F.col("e_id").isNotNull() & ((F.col("h1") != F.col("h")) | (F.col("h0") != F.col("h")))).alias("hash_mismatch"), F.count_if(F.col("blank")).alias("empty"), F.count_if(F.col("len") > 250).alias("over_limit"),
    )


@query("SELECT c_custkey, coalesce(p.v, c_acctbal) AS acctbal, p.k IS NOT NULL AS patched FROM customer LEFT JOIN (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier) p ON p.k = c_custkey")
def keyed_patch(spark, d):
    patch = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    j = table(spark, d, "customer").join(patch, F.col("c_custkey") == F.col("k"), "left")
    return j.select("c_custkey", F.coalesce("v", "c_acctbal").alias("acctbal"), F.col("k").isNotNull().alias("patched"))


@query("SELECT a.row_id, a.value AS before, b.value AS after FROM runs1 a JOIN runs2 b ON a.row_id = b.row_id WHERE a.value <> b.value".replace("runs1", "(SELECT l_orderkey AS row_id, l_quantity AS value FROM lineitem WHERE l_linenumber = 1)").replace("runs2", "(SELECT l_orderkey AS row_id, least(l_quantity, 40) AS value FROM lineitem WHERE l_linenumber = 1)"))
def changed_rows(spark, d):
    a = runs(spark, d).filter("model = 'm1'").select("row_id", F.col("value").alias("before"))
    b = runs(spark, d).filter("model = 'm1'").select("row_id", F.least("value", F.lit(40.0)).alias("after"))
    return a.join(b, "row_id").filter("before <> after").select("row_id", "before", "after")


@query("SELECT r_name || ' ' || t.s || ' ' || n_name AS phrase, r_regionkey, n_nationkey FROM region, nation, (VALUES ('in'), ('of')) t(s)")
def cross_templates(spark, d):
    t = spark.createDataFrame([("in",), ("of",)], "s string")
    x = table(spark, d, "region").crossJoin(F.broadcast(table(spark, d, "nation"))).crossJoin(F.broadcast(t))
    return x.select(F.format_string("%s %s %s", "r_name", "s", "n_name").alias("phrase"), "r_regionkey", "n_nationkey")


@query("SELECT event_id, m.label FROM events JOIN (VALUES ('click', 'ui'), ('purchase', 'money'), ('view', 'ui')) m(t, label) ON m.t = event_type")
def broadcast_lookup(spark, d):
    m = spark.createDataFrame([("click", "ui"), ("purchase", "money"), ("view", "ui")], "event_type string, label string")
    return table(spark, d, "events").join(F.broadcast(m), "event_type").select("event_id", "label")


@query("SELECT a.i, a.line AS first_line, b.line AS second_line FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, n_name AS line FROM nation) a JOIN (SELECT row_number() OVER (ORDER BY n_name) AS i, n_name AS line FROM nation) b ON a.i = b.i")
def positional_zip(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.row_number().over(Window.orderBy("n_nationkey")).cast("long").alias("i"), F.col("n_name").alias("first_line"))
    return a.join(n.select(F.row_number().over(Window.orderBy("n_name")).cast("long").alias("i"), F.col("n_name").alias("second_line")), "i")


# --- aggregations --------------------------------------------------------------------------------------------------------

_AUDIT = "WITH " + _PAIRS + f"""c AS (SELECT *, coalesce(en, '') AS e, coalesce(vi, '') AS v, en IS NOT NULL AND vi IS NOT NULL AS t FROM pairs),
x AS (SELECT *, {_clean('e')} AS ce, {_clean('v')} AS cv FROM c),
per AS (SELECT source_short_name, count(*) AS n_rows, count(*) FILTER (NOT t) AS non_string, count(*) FILTER (t AND (ce = '' OR cv = '')) AS null_or_blank,
 count(*) FILTER (regexp_matches(e || v, '{_C}') OR contains(e || v, '�')) AS control, count(*) FILTER (t AND ce = cv) AS identical,
 count(*) FILTER (t AND (length(ce) / greatest(length(cv), 1) > 3.5 OR length(ce) / greatest(length(cv), 1) < 1 / 3.5)) AS extreme_ratio,
 count(*) FILTER (t AND (length(ce) > 1000 OR length(cv) > 1000)) AS very_long,
 count(*) FILTER (t AND NOT (regexp_matches(ce, '[A-Za-zÀ-ỹ]') AND regexp_matches(cv, '[A-Za-zÀ-ỹ]'))) AS no_letters,
 count(*) - count(DISTINCT (en, vi)) AS duplicates FROM x GROUP BY source_short_name)
SELECT source_short_name, sum(n_rows)::BIGINT AS n_rows, sum(non_string)::BIGINT AS non_string, sum(null_or_blank)::BIGINT AS null_or_blank, sum(control)::BIGINT AS control, sum(identical)::BIGINT AS identical,
 sum(extreme_ratio)::BIGINT AS extreme_ratio, sum(very_long)::BIGINT AS very_long, sum(no_letters)::BIGINT AS no_letters, sum(duplicates)::BIGINT AS duplicates FROM per GROUP BY ROLLUP (source_short_name)"""


@query(_AUDIT)
def audit_raw(spark, d):
    return P.audit(pairs(spark, d))


@query("SELECT lang, source, count(*) AS n_rows FROM documents GROUP BY lang, source ORDER BY lang, source")
def group_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n_rows")).orderBy("lang", "source")


@query("WITH " + _TAGGED + ", n AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY tag) SELECT k.tag, coalesce(n.n, 0)::BIGINT AS n_pairs FROM (VALUES " + ", ".join(f"('{k}')" for k in T.TAG_PATTERNS) + ") k(tag) LEFT JOIN n ON n.tag = k.tag")
def tag_frequency(spark, d):
    n = P.described(P.cleaned(pairs(spark, d))).select(F.explode("technical_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(k,) for k in T.TAG_PATTERNS], "tag string")
    return known.join(n, "tag", "left").select("tag", F.coalesce("n", F.lit(0).cast("long")).alias("n_pairs"))


@query("WITH " + _VALID + "SELECT (SELECT count(*) FROM pairs) AS raw_rows, count(*) AS cleaned_rows, count(*) FILTER (copy = 1) AS released_rows FROM copies")
def attrition(spark, d):
    return P.attrition(pairs(spark, d))


_RELEASE = "WITH " + _SPLIT + """SELECT sha256(k.source_short_name || ':' || k.raw_row_index || ':' || k.global_key) AS dataset_row_id, a.split, k.source_short_name, k.raw_row_index, k.en_clean, k.vi_clean,
 k.primary_group, array_to_string(k.tags, ',') AS technical_tags, k.group_method, sha256(to_json([k.en_clean, k.vi_clean])::VARCHAR) AS pair_sha256, k.leakage_group_id FROM kept k JOIN assigned a ON a.leakage_group_id = k.leakage_group_id"""


@query(_RELEASE)
def release_pairs(spark, d):
    return P.release(pairs(spark, d)).withColumn("technical_tags", F.array_join("technical_tags", ","))


@query("WITH " + _SPLIT + "SELECT a.split, k.primary_group, count(*) AS n_rows FROM kept k JOIN assigned a ON a.leakage_group_id = k.leakage_group_id GROUP BY 1, 2")
def split_counts(spark, d):
    return P.release(pairs(spark, d)).groupBy("split", "primary_group").agg(F.count("*").alias("n_rows"))


@query("WITH " + _VALID + """, dealt AS (SELECT *, CASE raw_row_index % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'it_test' END AS split FROM copies)
SELECT v.split, v.kind, (SELECT count(DISTINCT CASE v.kind WHEN 'english' THEN a.en_key ELSE a.global_key END) FROM dealt a JOIN dealt b
  ON b.split = v.split AND a.split = 'train' AND CASE v.kind WHEN 'english' THEN a.en_key = b.en_key ELSE a.global_key = b.global_key END) AS shared
FROM (VALUES ('validation', 'english'), ('validation', 'pair'), ('it_test', 'english'), ('it_test', 'pair')) v(split, kind)""")
def leakage_overlap(spark, d):
    """What a split by row number would share, copies and all; that of the release shares nothing (a test says so)."""
    split = F.element_at(F.array(*map(F.lit, ("train", "validation", "it_test"))), (F.col("raw_row_index") % 3 + 1).cast("int"))
    return P.leakage(P.keyed(P.cleaned(pairs(spark, d))).withColumn("split", split))


@query("WITH " + _VALID + "SELECT source_short_name, raw_row_index, copy FROM copies WHERE copy > 1")
def removed_duplicates(spark, d):
    return P.ranked_copies(P.cleaned(pairs(spark, d))).filter("copy > 1").select("source_short_name", "raw_row_index", F.col("copy").cast("long").alias("copy"))


@query("SELECT event_type, count(*) AS n_rows, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS rate_percent FROM events GROUP BY event_type")
def value_rates(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n_rows"))
    everything = Window.partitionBy(F.lit(1))
    return n.withColumn("rate_percent", F.round(100.0 * F.col("n_rows") / F.sum("n_rows").over(everything), 3))


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies FROM documents QUALIFY copies > 1")
def duplicate_group_sizes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.count("*").over(Window.partitionBy("text")).alias("copies")).filter("copies > 1")


@query("SELECT source, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS langs, count(DISTINCT lang) = 4 AS complete FROM documents GROUP BY source")
def distinct_joined(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("langs"), (F.count_distinct("lang") == 4).alias("complete"))


@query("SELECT lang, max(n_chars) AS longest, count(*) FILTER (n_chars > 1000) AS over_1000, count(*) FILTER (n_chars > 5000) AS over_5000, round(100.0 * count(*) FILTER (n_chars > 1000) / count(*), 6) AS percent FROM documents GROUP BY lang")
def length_audit(spark, d):
    over = lambda n: F.count_if(F.col("n_chars") > n)
    return table(spark, d, "documents").groupBy("lang").agg(F.max("n_chars").alias("longest"), over(1000).alias("over_1000"), over(5000).alias("over_5000"), F.round(100.0 * over(1000) / F.count("*"), 6).alias("percent"))


_TERMS = "t AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS form FROM conversations), k AS (SELECT *, lower(form) AS term FROM t), df AS (SELECT term, count(DISTINCT (conv_id, turn)) AS n FROM k GROUP BY term), forms AS (SELECT term, form, count(*) AS c FROM k GROUP BY 1, 2)"


@query(f"WITH {_TERMS} SELECT df.term, df.n, (SELECT f.form FROM forms f WHERE f.term = df.term ORDER BY f.c DESC, f.form LIMIT 1) AS surface FROM df ORDER BY n DESC, term LIMIT 200")
def document_frequency_top(spark, d):
    """The 200 terms in most turns, each with its most frequent form; ties go to the lesser text."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("form")).distinct().withColumn("term", F.lower("form"))
    forms = t.groupBy("term", "form").agg(F.count("*").alias("c"))
    best = forms.groupBy("term").agg(F.min(F.struct((-F.col("c")).alias("c"), "form")).alias("b")).select("term", F.col("b.form").alias("surface"))
    df = t.select("conv_id", "turn", "term").distinct().groupBy("term").agg(F.count("*").alias("n"))
    return df.join(best, "term").orderBy(F.desc("n"), "term").limit(200).select("term", "n", "surface")


@query()
def corpus_metrics(spark, d):
    return metrics.corpus_scores(replies(spark, d).withColumn("parity", F.col("conv_id") % 2), by=("parity",))


@query("SELECT event_type, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 9).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 9).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 9).alias("p95"))


@query("SELECT l_linestatus, round(avg((l_linenumber = l_quantity)::INT), 9) AS exact_match FROM lineitem GROUP BY 1")
def exact_match_rate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.avg((F.col("l_linenumber") == F.col("l_quantity")).cast("int")), 9).alias("exact_match"))


@query("WITH t AS (SELECT conv_id, unnest(['the', 'and', 'of']) AS term, text FROM conversations) SELECT term, round(avg(contains(lower(text), term)::INT), 9) AS kept FROM t GROUP BY term")
def term_kept_ratio(spark, d):
    x = table(spark, d, "conversations").withColumn("term", F.explode(F.array(*map(F.lit, ("the", "and", "of")))))
    return x.groupBy("term").agg(F.round(F.avg(F.lower("text").contains(F.col("term")).cast("int")), 9).alias("kept"))


@query("SELECT role, counter, count(*) AS n FROM (SELECT role, unnest(list_filter([CASE WHEN length(text) > 200 THEN 'long' END, CASE WHEN contains(text, '?') THEN 'question' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END], lambda x: x IS NOT NULL)) AS counter FROM conversations) GROUP BY 1, 2")
def calibration_counters(spark, d):
    c = F.array_compact(F.array(F.when(F.length("text") > 200, "long"), F.when(F.col("text").contains("?"), "question"), F.when(F.col("text").rlike("[0-9]"), "digits")))
    return table(spark, d, "conversations").select("role", F.explode(c).alias("counter")).groupBy("role", "counter").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (l_returnflag = 'A') AS yes, count(*) FILTER (l_returnflag = 'N') AS no, count(*) FILTER (l_returnflag = 'R') AS unclear FROM lineitem")
def review_tallies(spark, d):
    return table(spark, d, "lineitem").agg(*(F.count_if(F.col("l_returnflag") == k).alias(v) for k, v in (("A", "yes"), ("N", "no"), ("R", "unclear"))))


@query("SELECT c_mktsegment, sha256(string_agg(c_name, chr(0) ORDER BY c_custkey)) AS cohort_sha256 FROM customer GROUP BY 1")
def cohort_hash(spark, d):
    names = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"])
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.sha2(F.array_join(names, "\0"), 256).alias("cohort_sha256"))


@query("SELECT count(*) FILTER (n > 1) AS segmented_rows, max(n) AS most_segments FROM (SELECT ceil(n_chars / 1000)::BIGINT AS n FROM documents)")
def segment_stats(spark, d):
    n = table(spark, d, "documents").select(F.ceil(F.col("n_chars") / 1000).alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("segmented_rows"), F.max("n").alias("most_segments"))


@query("SELECT count(*) FILTER (a.l_returnflag = b.l_returnflag) AS agree, count(*) AS n_rows FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2")
def tier_agreement(spark, d):
    t = table(spark, d, "lineitem")
    a, b = (t.filter(F.col("l_linenumber") == n).select("l_orderkey", F.col("l_returnflag").alias(f"f{n}")) for n in (1, 2))
    return a.join(b, "l_orderkey").agg(F.count_if(F.col("f1") == F.col("f2")).alias("agree"), F.count("*").alias("n_rows"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / len(embedding)), 9) AS rms FROM embeddings")
def rms_energy(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(total / F.size("embedding")), 9).alias("rms"))


@query("SELECT conv_id, count(*) AS messages, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def conversation_sizes(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))


# --- windows, sorts, sets ------------------------------------------------------------------------------------------------


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) <= 5")
def stratified_sample(spark, d):
    w = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256), "doc_id")
    return table(spark, d, "documents").select("lang", "doc_id", F.row_number().over(w).alias("rn")).filter("rn <= 5").drop("rn")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 4 AS shard FROM orders")
def modular_shards(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.pmod(F.row_number().over(w) - 1, F.lit(4)).cast("long").alias("shard"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events")
def last_event_time(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("ts")), ignorenulls=True).over(w).alias("last_click"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 16) UNION SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 16)")
def first_and_longest(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars")
    return t.orderBy("doc_id").limit(16).select("doc_id").union(t.orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(16).select("doc_id")).distinct()


@query("SELECT source, doc_id, n_chars FROM documents ORDER BY source, n_chars DESC, doc_id")
def stable_sort(spark, d):
    return table(spark, d, "documents").select("source", "doc_id", "n_chars").orderBy("source", F.desc("n_chars"), "doc_id")


@query("SELECT doc_id FROM documents ORDER BY (lang IN ('de', 'es')) DESC, sha256('phase02-review:' || doc_id), doc_id LIMIT 50")
def review_sample(spark, d):
    rank = F.sha2(F.concat(F.lit("phase02-review:"), F.col("doc_id").cast("string")), 256)
    return table(spark, d, "documents").orderBy(F.desc(F.col("lang").isin("de", "es")), rank, "doc_id").limit(50).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 8")
def longest_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(8)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def newest_log_rows(spark, d):
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_k_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT row_id FROM (SELECT l_orderkey AS row_id FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4) ORDER BY sha256(row_id::VARCHAR), row_id LIMIT 5")
def common_ids(spark, d):
    """The five common ids that come first by hash: a sample for review."""
    t = table(spark, d, "lineitem")
    both = t.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("row_id")).intersect(t.filter("l_linenumber = 4").select("l_orderkey"))
    return both.orderBy(F.sha2(F.col("row_id").cast("string"), 256), "row_id").limit(5)


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def missing_ids(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("SELECT (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) = 0 AND (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)) = 0 AS same_sets")
def set_equality(spark, d):
    a, b = table(spark, d, "nation").select(F.col("n_regionkey").alias("k")), table(spark, d, "region").select(F.col("r_regionkey").alias("k"))
    both = a.subtract(b).agg(F.count("*").alias("x")).crossJoin(b.subtract(a).agg(F.count("*").alias("y")))
    return both.select(((F.col("x") == 0) & (F.col("y") == 0)).alias("same_sets"))


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_rows(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("SELECT count(*) = count(DISTINCT doc_id) AS ids_unique, count(*) = count(DISTINCT text) AS texts_unique FROM documents")
def uniqueness_gate(spark, d):
    return table(spark, d, "documents").agg((F.count("*") == F.count_distinct("doc_id")).alias("ids_unique"), (F.count("*") == F.count_distinct("text")).alias("texts_unique"))


# --- scalar functions ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(to_json([lang, text])::VARCHAR) AS pair_sha256, substr(sha256('42:' || doc_id), 1, 16) AS stable, sha256(lang || '␟' || source) AS key_sha256 FROM documents")
def hashes(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", T.pair_hash(F.col("lang"), F.col("text")).alias("pair_sha256"), T.stable_rank(F.col("doc_id").cast("string"), "42").alias("stable"), T.key_hash(F.col("lang"), F.col("source")).alias("key_sha256"))


@query("WITH " + _GROUPED + " SELECT raw_row_index, array_to_string(tags, ',') AS tags, primary_group, group_method FROM grouped")
def tags_and_groups(spark, d):
    return P.described(P.cleaned(pairs(spark, d))).select("raw_row_index", F.array_join("technical_tags", ",").alias("tags"), "primary_group", "group_method")


@query("SELECT doc_id, " + _clean(f"regexp_replace(text, '{T.DELETED}', '', 'g')") + " AS clean FROM documents")
def input_normalization(spark, d):
    return table(spark, d, "documents").select("doc_id", T.input_normalized(F.col("text")).alias("clean"))


@query("SELECT page_id, regexp_replace(url, '^https:\\s?', '') AS bare, '>>en<< ' || url AS prefixed, least(512, 2 * length(url) + 20) AS most FROM pages")
def prefix_functions(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https:\s?", "").alias("bare"), F.concat(F.lit(">>en<< "), "url").alias("prefixed"), T.decode_limit(F.length("url").cast("long")).alias("most"))


@query("""WITH l AS (SELECT doc_id, trim(string_split(trim(text), chr(10))[1]) AS line FROM documents) SELECT doc_id, CASE WHEN length(line) <= 60 THEN line ELSE rtrim(left(line, 59)) || '…' END AS title FROM l""")
def titles(spark, d):
    return table(spark, d, "documents").select("doc_id", T.title(F.col("text")).alias("title"))


@query("""WITH m AS (SELECT max(ts)::DATE AS today FROM events) SELECT event_id, CASE WHEN n <= 0 THEN 0 WHEN n = 1 THEN 1 WHEN n < 7 THEN 2 WHEN n < 30 THEN 3 ELSE 4 END AS bucket
FROM (SELECT event_id, date_diff('day', ts::DATE, today) AS n FROM events, m)""")
def history_buckets(spark, d):
    e = table(spark, d, "events")
    today = e.agg(F.to_date(F.max("ts")).alias("today"))
    return e.crossJoin(F.broadcast(today)).select("event_id", T.day_bucket(F.to_date("ts"), F.col("today")).alias("bucket"))


@query("SELECT event_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, 0) + coalesce(b, 0) END AS total FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS a, CASE WHEN event_id % 4 = 0 THEN event_id END AS b FROM events)")
def timing_totals(spark, d):
    a, b = F.when(F.col("event_id") % 3 == 0, F.col("user_id")), F.when(F.col("event_id") % 4 == 0, F.col("event_id"))
    return table(spark, d, "events").select("event_id", T.total_time(a, b).alias("total"))


_GUESS = """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS m, l_suppkey % 4 AS p, l_linenumber % 3 AS s, l_partkey % 5 AS e, l_orderkey % 4 AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN m + p + s + e + f = 0 THEN 'uncertain'
 WHEN m > 0 THEN CASE WHEN (e >= 2 AND e > m + p) OR (e >= 1 AND e + f >= 2 * (m + p)) THEN 'mixed' ELSE 'vi_high' END
 WHEN p = 0 AND ((e >= 2 AND e > s) OR (s = 0 AND ((e >= 1 AND f >= 2) OR f >= 3))) THEN 'en_high'
 WHEN e >= 2 AND e >= 3 * p AND e + f >= (3 * (m + p + s + e + f) + 4) // 5 THEN 'en_high'
 WHEN p >= 2 AND p > e AND p + s >= e + f THEN 'vi_high' WHEN p + s >= 2 AND e >= 2 THEN 'mixed' ELSE 'uncertain' END AS guess FROM e"""


@query(_GUESS)
def language_guesses(spark, d):
    c = [F.col("l_partkey") % 3, F.col("l_suppkey") % 4, (F.col("l_linenumber") % 3).cast("long"), F.col("l_partkey") % 5, F.col("l_orderkey") % 4]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.language_guess(*c).alias("guess"))


@query()
def bare_syllables(spark, d):
    w = table(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''").distinct()
    return w.select("word", T.is_bare_syllable(F.col("word")).alias("syllable"))


@query()
def text_sequences(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", Q.collapse_loops("text").alias("collapsed"), Q.clean_english_transcript("text").alias("transcript"), F.size(Q.to_speech_chunks("text")).alias("chunks"), F.size(Q.to_segments(120)("text")).alias("segments"), T.graphemes("text").alias("length"))


# --- streams, in their batch form ----------------------------------------------------------------------------------------


def frames(spark, d):
    """Frames of 32 ms a user, spoken where the event's value is high."""
    e = table(spark, d, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("session_id"), i.alias("seq"), (i * 500).cast("long").alias("elapsed_ms"), ((i - 1) * 500).cast("long").alias("begin_ms"), (F.col("event_type") == "click").alias("is_speech"))


_FRAMES = "f AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type = 'click' AS sp FROM events)"


@query(f"""WITH {_FRAMES}, g AS (SELECT *, seq * 500 AS el, max(CASE WHEN sp THEN seq * 500 END) OVER (PARTITION BY session_id ORDER BY seq) AS last FROM f),
r AS (SELECT *, CASE WHEN el >= 60000 THEN 'MAX_TURN' WHEN last IS NULL AND el >= 6000 THEN 'NO_SPEECH' WHEN last IS NOT NULL AND NOT sp AND el - last >= 1500 THEN 'END_SILENCE' END AS reason FROM g)
SELECT session_id, reason, el::BIGINT AS ended_ms FROM r WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) = 1""")
def turn_ends(spark, d):
    return endpointing.ends(frames(spark, d))


@query(f"""WITH {_FRAMES}, g AS (SELECT *, max(seq) OVER (PARTITION BY session_id) * 500 AS fin, seq - row_number() OVER (PARTITION BY session_id, sp ORDER BY seq) AS run FROM f)
SELECT session_id, ((min(seq) - 1) * 500)::BIGINT AS start_ms, (max(seq) * 500)::BIGINT AS end_ms, greatest(0, (min(seq) - 1) * 500 - 400)::BIGINT AS from_ms, least(min(fin), max(seq) * 500 + 200)::BIGINT AS to_ms
FROM g WHERE sp GROUP BY session_id, run""")
def voice_segments(spark, d):
    return endpointing.segments(frames(spark, d))


@query()
def conversation_effects(spark, d):
    """Events of a made conversation per user: what a tap, a recognised text, a translation and an end of speech do."""
    e = table(spark, d, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kinds = F.array(*map(F.lit, ("tap", "listen_ended", "translated", "speak_done", "typed")))
    kind = F.element_at(kinds, (F.pmod(F.hash("event_type", "event_id"), F.lit(5)) + 1).cast("int"))
    result = F.when(kind == "listen_ended", "text").when(kind == "translated", "ok")
    events = e.select(F.col("user_id").alias("conv_id"), i.cast("long").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("party"), F.pmod(i, F.lit(7)).cast("long").alias("turn"), F.pmod(i, F.lit(3)).cast("long").alias("speak_id"), F.lit("x").alias("text"), F.lit(False).alias("keep"), result.alias("result"))
    return conversation.effects(events)


@query("WITH gone AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 95) SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM gone)")
def tombstones(spark, d):
    e = table(spark, d, "events")
    gone = e.filter("event_type = 'purchase' and value > 95").select("user_id").distinct()
    return e.join(gone, "user_id", "left_anti").select("event_id")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS merged FROM conversations GROUP BY conv_id")
def merge_segments_by_start(spark, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(parts, " ").alias("merged"))
