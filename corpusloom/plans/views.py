"""Queries of messages made from effects, bounded queues, model features and escapes, with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import adapters
from ..streaming import view
from .queries import query, table


def made_effects(spark, d):
    """Each turn is added; some are translated, cut, replaced and translated anew; some effects are for turns that aren't there."""
    t = table(spark, d, "conversations")
    text, again = F.col("text"), (F.col("conv_id") + F.col("turn")) % 5 == 0
    rows = [
        (F.lit(True), 0, "add_message", F.col("role"), text, ["n1"]),
        (F.col("turn") % 3 != 0, 1, "set_translation:ok", F.lit(None), F.md5(text), ["n1", "n2"]),
        (F.col("turn") % 4 == 0, 2, "mark_interrupted", F.lit(None), F.lit(None), []),
        (again, 3, "replace_source", F.lit("typist"), F.md5(F.concat(F.lit("r"), text)), ["n3"]),
        (again & (F.col("turn") % 2 == 0), 4, "set_translation:invalid", F.lit(None), F.md5(F.concat(F.lit("i"), text)), ["n4", "n3"]),
    ]
    entry = [
        F.when(when, F.struct(F.lit(at).alias("at"), F.lit(effect).alias("effect"), party.cast("string").alias("party"), said.cast("string").alias("text"), F.array(*map(F.lit, notes)).cast("array<string>").alias("notes")))
        for when, at, effect, party, said, notes in rows
    ]
    own = t.select("conv_id", "turn", F.explode(F.array_compact(F.array(*entry))).alias("e"))
    stray = own.filter("e.at > 0").withColumn("turn", F.col("turn") + 1_000_000)
    x = own.unionByName(stray).select("conv_id", "turn", (F.col("turn") * 10 + F.col("e.at")).alias("seq"), "e.effect", "e.party", "e.text", "e.notes")
    return x.withColumn("typed", F.col("effect") == "replace_source")


@query("""WITH x AS (SELECT *, (conv_id + turn) % 5 = 0 AS edited FROM conversations)
SELECT conv_id, turn, CASE WHEN edited THEN 'typist' ELSE role END AS party, CASE WHEN edited THEN md5('r' || text) ELSE text END AS text,
CASE WHEN edited THEN CASE WHEN turn % 2 = 0 THEN md5('i' || text) END WHEN turn % 3 <> 0 THEN md5(text) END AS translation,
CASE WHEN edited AND turn % 2 = 0 THEN 'invalid' WHEN edited OR turn % 3 = 0 THEN 'translating' ELSE 'ok' END AS status, edited AS typed, edited,
NOT edited AND turn % 4 = 0 AS interrupted, CASE WHEN edited AND turn % 2 = 0 THEN 'n3,n4' WHEN edited THEN 'n3' WHEN turn % 3 = 0 THEN 'n1' ELSE 'n1,n2' END AS notes FROM x""")
def conversation_view(spark, d):
    return view.messages(made_effects(spark, d)).withColumn("notes", F.array_join("notes", ","))


@query("""WITH x AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ready, 1000 * (event_id % 977) AS took FROM events),
s AS (SELECT *, sum(took) OVER w AS total FROM x WINDOW w AS (PARTITION BY event_type ORDER BY ready, event_id)),
e AS (SELECT *, total + max(ready - (total - took)) OVER (PARTITION BY event_type ORDER BY ready, event_id) AS ended FROM s)
SELECT event_id, greatest(ready, coalesce(lag(ended - took, 64) OVER (PARTITION BY event_type ORDER BY ready, event_id), ready))::BIGINT AS accepted_at, (ended - took)::BIGINT AS started_at, ended::BIGINT AS ended_at FROM e""")
def bounded_queue(spark, d):
    """When events of each type get through a queue of 64 whose consumer needs up to 976 seconds for one."""
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ready"), (F.col("event_id") % 977 * 1000).alias("took"))
    e = e.withColumn("place", F.struct("ready", "event_id"))
    return view.admitted(e, "event_type", "place", "ready", "took").select("event_id", "accepted_at", "started_at", "ended_at")


def _word_lengths():
    return lambda text: [len(w) for w in text.split(" ")]


@query("""WITH x AS (SELECT a.conv_id, a.turn, a.text AS en, b.text AS vi FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')
SELECT conv_id, turn, array_to_string([length(w) FOR w IN string_split(en, ' ')], ' ') AS input_ids, len(string_split(en, ' '))::BIGINT AS attended, array_to_string([length(w) FOR w IN string_split(vi, ' ')], ' ') AS labels FROM x""")
def training_features(spark, d):
    """Ids of each asked turn and of its answer, by an encoder that stands for a tokenizer."""
    t = table(spark, d, "conversations")
    answer = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("vi"))
    rows = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("en")).join(answer, ["conv_id", "turn"], "left")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return adapters.features(rows, "en", "vi", _word_lengths).select("conv_id", "turn", joined("input_ids"), F.size("attention_mask").cast("long").alias("attended"), joined("labels"))


@query("""WITH c AS (SELECT DISTINCT lang, ord(unnest(list_distinct(string_split(text, '')))) AS p FROM documents),
i AS (SELECT lang, p, p - row_number() OVER (PARTITION BY lang ORDER BY p) AS island FROM c),
r AS (SELECT lang, min(p) AS a, max(p) AS b FROM i GROUP BY lang, island)
SELECT lang, string_agg('U+' || lpad(hex(a), greatest(length(hex(a)), 4)::INT, '0') || CASE WHEN a < b THEN '-U+' || lpad(hex(b), greatest(length(hex(b)), 4)::INT, '0') ELSE '' END, ' ' ORDER BY a) AS ranges FROM r GROUP BY lang""")
def character_ranges(spark, d):
    """The characters that each language's texts use; a text's distinct ones are shuffled, at most all code points collected."""
    own = F.array_distinct(F.filter(F.split("text", ""), lambda c: c != ""))
    points = table(spark, d, "documents").select("lang", F.explode(own).alias("c")).distinct().groupBy("lang").agg(F.collect_list(F.ascii("c")).alias("points"))
    return points.select("lang", T.code_point_ranges(F.col("points")).alias("ranges"))


@query()
def escaped_documents(spark, d):
    """Each document as JSON without invisible characters; whether it decodes to the same text."""
    x = table(spark, d, "documents").select("doc_id", "text", T.invisible_escaped(F.to_json(F.struct("text"))).alias("json"))
    return x.select("doc_id", "json", F.get_json_object("json", "$.text").eqNullSafe(F.col("text")).alias("same"))
