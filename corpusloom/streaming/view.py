"""The messages of conversations as their effects leave them, and the waiting of a bounded queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUEUE_ITEMS = 64
_SHOWN = "set_translation"


def messages(effects: DataFrame) -> DataFrame:
    """conv_id, turn, party, text, translation, status, typed, edited, interrupted, notes: a row for each message.

    Effects: conv_id, seq, turn, effect, party, text, typed, notes. `add_message` makes a turn's message, `replace_source`
    puts a new text in its place and forgets what was translated, `set_translation:<status>` adds a translation and its notes
    (each once), `mark_interrupted` says that its speech was cut; the others, and those for a turn without a message, change
    nothing. Effects of one event share its seq; a translation counts for the source of the same event. Null notes are none.
    One aggregate by turn, so that a stream of effects gives the changed messages in update mode, to be merged by key."""
    told = F.col("effect").isin("add_message", "replace_source", "mark_interrupted") | F.startswith(F.col("effect"), F.lit(_SHOWN))
    entry = F.struct("seq", "effect", "party", "text", "typed", F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))
    x = effects.filter(told & F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    added = F.filter("all", lambda e: e["effect"] == "add_message")
    x = x.withColumn("begun", F.get(added, F.lit(0))["seq"]).withColumn("sources", F.filter("all", lambda e: e["effect"].isin("add_message", "replace_source") & (e["seq"] >= F.col("begun"))))
    x = x.withColumn("source", F.get("sources", F.size("sources") - 1))
    since = lambda test: F.filter("all", lambda e: test(e["effect"]) & (e["seq"] >= F.col("source.seq")))
    x = x.withColumn("shown", since(lambda e: F.startswith(e, F.lit(_SHOWN)))).withColumn("last", F.get("shown", F.size("shown") - 1))
    notes = F.array_distinct(F.concat("source.notes", F.flatten(F.transform("shown", lambda e: e["notes"]))))
    return x.filter("begun is not null").select(
        "conv_id", "turn", "source.party", "source.text", F.col("last.text").alias("translation"),
        F.coalesce(F.substring_index("last.effect", ":", -1), F.lit("translating")).alias("status"), "source.typed",
        (F.col("source.effect") == "replace_source").alias("edited"), (F.size(since(lambda e: e == "mark_interrupted")) > 0).alias("interrupted"), notes.alias("notes"),
    )


def admitted(items: DataFrame, queue: str, order: str, ready: str, took: str, most: int = QUEUE_ITEMS) -> DataFrame:
    """items with accepted_at, started_at and ended_at, as whole numbers like `ready` and `took`.

    A queue holds `most` items that wait; its consumer takes them one by one, in order, and needs `took` for each. The
    producer has an item at `ready`, not before the one ahead of it, and holds it until there is room, that is until the item
    `most` places ahead has started. The consumer's idle time is a running maximum, so no loop is needed."""
    w = Window.partitionBy(queue).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = items.withColumn("_sum", F.sum(took).over(so_far))
    x = x.withColumn("ended_at", F.col("_sum") + F.max(F.col(ready) - F.col("_sum") + F.col(took)).over(so_far))
    x = x.withColumn("started_at", F.col("ended_at") - F.col(took))
    return x.withColumn("accepted_at", F.greatest(F.col(ready), F.lag("started_at", most).over(w))).drop("_sum")


def bounded_stream(spark: SparkSession, path: str, schema, files: int = QUEUE_ITEMS) -> DataFrame:
    """Parquet files that come into a folder, as a stream that takes no more than `files` of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
