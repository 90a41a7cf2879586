"""Queries of the gates and timers, with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..streaming import timers
from .queries import _FRAMES, calibration_counters, frames, query, table

@query("SELECT o_orderstatus, o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'price' ELSE 'priority' END AS problem FROM orders WHERE o_totalprice < 50000 OR o_orderpriority = '5-LOW' QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) = 1")
def gate_first_errors(spark, d):
    return G.first_errors(table(spark, d, "orders"), "o_orderstatus", "o_orderkey", {"price": F.col("o_totalprice") >= 50000, "priority": F.col("o_orderpriority") != "5-LOW"})


@query("""WITH l AS (SELECT p_partkey AS path, p_size::BIGINT AS bytes FROM part WHERE p_partkey % 13 <> 0 UNION ALL SELECT p_partkey, p_size::BIGINT FROM part WHERE p_partkey % 17 = 0),
u AS (SELECT path, count(*) AS n, min(bytes) AS bytes FROM l GROUP BY path),
f AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END::BIGINT AS bytes FROM part WHERE p_partkey % 7 <> 0),
x AS (SELECT coalesce(u.path, f.path) AS path, n, f.path IS NOT NULL AS there, u.bytes AS a, f.bytes AS b FROM u FULL JOIN f ON u.path = f.path)
SELECT path, unnest(list_filter([CASE WHEN n > 1 THEN 'listed_twice' END, CASE WHEN NOT there THEN 'missing' END, CASE WHEN n IS NULL THEN 'unlisted' END, CASE WHEN n IS NOT NULL AND there AND a IS DISTINCT FROM b THEN 'bytes_differs' END], lambda v: v IS NOT NULL)) AS problem FROM x""")
def gate_manifest(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("long").alias("bytes"))
    listed = p.filter("path % 13 <> 0").unionByName(p.filter("path % 17 = 0"))
    found = p.filter("path % 7 <> 0").withColumn("bytes", F.when(F.col("path") % 11 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return G.manifest_problems(listed, found, "path", ("bytes",))


@query("""WITH r AS (SELECT o_orderkey AS row_id, floor(o_totalprice)::BIGINT AS tokens FROM orders),
p AS (SELECT row_id, tokens + CASE WHEN row_id % 9 = 0 THEN 1 ELSE 0 END AS tokens FROM r WHERE (tokens > 300000 AND row_id % 10 <> 0) OR row_id % 997 = 0 UNION ALL SELECT -1, 5),
x AS (SELECT coalesce(r.row_id, p.row_id) AS row_id, r.tokens AS is_, p.tokens AS said, p.row_id IS NOT NULL AS listed FROM r FULL JOIN p ON r.row_id = p.row_id)
SELECT * FROM (SELECT row_id, CASE WHEN is_ IS NULL THEN 'unknown_row' WHEN NOT listed AND is_ > 300000 THEN 'not_excluded' WHEN listed AND is_ <= 300000 THEN 'within_limit' WHEN listed AND said <> is_ THEN 'count_differs' END AS problem FROM x) WHERE problem IS NOT NULL""")
def gate_exclusions(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.floor("o_totalprice").alias("tokens"))
    p = r.filter("(tokens > 300000 and row_id % 10 <> 0) or row_id % 997 = 0").withColumn("tokens", F.col("tokens") + F.when(F.col("row_id") % 9 == 0, 1).otherwise(0))
    alien = spark.range(1).select(F.lit(-1).cast("long").alias("row_id"), F.lit(5).cast("long").alias("tokens"))
    return G.exclusion_problems(p.unionByName(alien), r, 300000)


_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '')"


@query(f"""WITH p AS (SELECT DISTINCT regexp_replace(path, '/+$', '') AS path FROM (SELECT {_PATH} AS path FROM pages UNION ALL SELECT regexp_extract({_PATH}, '^[^/]*/[^/]*') FROM pages WHERE page_id % 3 = 0))
SELECT a.path AS outer, b.path AS inner FROM p a JOIN p b ON starts_with(b.path, a.path || '/')""".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'))  # fmt: skip
def gate_nested_paths(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "").alias("path"))
    return G.nested_paths(p.select("path").unionByName(p.filter("page_id % 3 = 0").select(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("path"))))


@query("""WITH c AS (SELECT role, counter, count(*) AS n FROM (SELECT role, unnest(list_filter([CASE WHEN length(text) > 200 THEN 'long' END, CASE WHEN contains(text, '?') THEN 'question' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END], lambda x: x IS NOT NULL)) AS counter FROM conversations) GROUP BY 1, 2),
t AS (SELECT role, count(*) AS n_rows FROM conversations GROUP BY 1)
SELECT role, counter, n * 1000 / n_rows AS per_mille FROM c JOIN t USING (role) WHERE n * 1000 / n_rows > CASE counter WHEN 'long' THEN 100.0 WHEN 'question' THEN 50.0 END""")
def gate_budgets(spark, d):
    total = table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n_rows"))
    return G.over_budget(calibration_counters(spark, d), total, {"long": 100.0, "question": 50.0}, "role")


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT regexp_matches(p_brand, '^[A-Za-z0-9][A-Za-z0-9._-]*$') THEN 'brand' END, CASE WHEN p_size <= 10 THEN 'size' END, CASE WHEN p_retailprice >= 1500 THEN 'price' END], lambda v: v IS NOT NULL), ',') AS problems FROM part""")
def gate_package(spark, d):
    checks = {"brand": F.col("p_brand").rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"), "size": F.col("p_size") > 10, "price": F.col("p_retailprice") < 1500}
    return table(spark, d, "part").select("p_partkey", F.array_join(G.problems(checks), ",").alias("problems"))


@query("""SELECT n_name, CASE WHEN count(c_custkey) = 0 THEN 'WAITING' WHEN count(*) FILTER (c_acctbal < -900) > 0 THEN 'FAIL' ELSE 'PASS' END AS state
FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey % 5 <> 0) c ON c_nationkey = n_nationkey GROUP BY n_name""")
def gate_states(spark, d):
    c = table(spark, d, "customer").filter("c_nationkey % 5 <> 0").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < -900).alias("bad"))
    x = table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return x.select("n_name", G.verdict(F.col("n"), F.col("bad")).alias("state"))


@query("SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) = range(1, count(*) + 1) AS same FROM lineitem GROUP BY 1")
def gate_known_errors(spark, d):
    """Whether the lines of an order are just those that are expected, in any order."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("is"), F.count("*").alias("n"))
    return x.select("l_orderkey", (F.col("is") == F.sequence(F.lit(1), F.col("n").cast("int"))).alias("same"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 90 AS approved FROM events")
def gate_protocol(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").select("event_id", k.between(10, 90).alias("approved"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Segment' ELSE '' END AS blanks FROM customer")
def gate_record_blanks(spark, d):
    value = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    record = F.concat(F.lit("| Field | Value |\n|-|-|\n| Name | "), "c_name", F.lit(" |\n| Segment | "), value, F.lit(" |\n"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(G.blank_fields(record), ",").alias("blanks"))


@query("SELECT event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lead(ts) OVER w IS NULL OR lead(ts) OVER w - ts >= INTERVAL 6 HOURS")
def debounced_saves(spark, d):
    return timers.debounced(table(spark, d, "events"), "user_id", "ts", "event_id", 6 * 3_600_000).select("event_id")


@query("SELECT event_id, ts + INTERVAL 10 SECONDS AS told_at FROM events WHERE CASE WHEN event_id % 5 <> 0 THEN ts + to_seconds(event_id % 20) ELSE TIMESTAMP '2024-01-20' END - ts > INTERVAL 10 SECONDS")
def watchdog(spark, d):
    end = F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("event_id") % 20))
    return timers.slow_steps(table(spark, d, "events").withColumn("ended", end), "ts", "ended", F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", "told_at")


@query(f"""WITH {_FRAMES}, g AS (SELECT *, seq - row_number() OVER (PARTITION BY session_id, sp ORDER BY seq) AS run FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY seq) - 1 AS nth FROM g WHERE sp) SELECT session_id, seq FROM n WHERE nth > 0 AND nth % 2 = 0""")
def partial_texts_due(spark, d):
    return timers.due_partials(frames(spark, d), 250)


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 40")
def capped_conversations(spark, d):
    return timers.accepted(table(spark, d, "events"), "user_id", "event_id", 40).select("event_id")
