"""Operator 1: mix sources to target weights, with DataFrame operations only.

Words are summed by source and hash bucket; the bucket in which a source's budget ends is the only one that is looked
into again, with finer buckets, until a bucket is one hash value. A document is then taken by comparing its hash with its
source's threshold: nothing is sorted by document.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a null doc_id hashes as the
empty string; rows with equal doc_id and source share one hash and are taken or left together; an empty table gives an
empty result. A document of any length counts whole. Other columns
of the input are ignored by mix().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, small

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: The hash has 60 bits; each level of the histogram splits a bucket by the next LEVEL_BITS.
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def doc_hash(doc_id):
    """60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, cap=MOST_COPIES) -> DataFrame:
    """(_source, source_size, target): shares of the total by weight; what a source can't hold goes to the others.

    With sources in the order of cap/weight, the capped ones are a prefix, so one pass of running sums finds them."""
    by_source = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    t = (
        by_source.withColumn("_rank", F.row_number().over(order))
        .withColumn("_w", weight)
        .withColumn("_cap", (F.lit(cap) * F.col("source_size")).cast("double"))
        .withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_weights", F.sum("_w").over(everything))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_rate", (F.col("_all") - F.col("_cap_before")) / (F.col("_weights") - F.col("_w_before")))
        .withColumn("_open", F.col("_cap") >= F.col("_rate") * F.col("_w"))
    )
    rate = F.min_by(F.when(F.col("_open"), F.col("_rate")), F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rank")))).over(everything)
    return t.withColumn("_final", rate).select(
        "_source", "source_size", F.when(F.col("_open"), F.col("_final") * F.col("_w")).otherwise(F.col("_cap")).alias("target")
    )


def thresholds(docs: DataFrame, doc_id="doc_id", source="source", text="text", weights=WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(sized: doc_id, _source, _size, _h; plan: a row per source with source_size, target, _whole copies and _low, the hash
    below which a document has one copy more)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"))
    sized = materialize(d.withColumn("_h", doc_hash(F.col("doc_id"))), "mix-sizes")
    plan = source_targets(sized, weights).select(
        "_source", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_whole")
    )
    plan = plan.withColumn("_budget", F.col("target") - F.col("_whole") * F.col("source_size")).withColumn("_low", F.lit(0).cast("long"))
    plan = materialize(plan, "mix-plan")
    _, fits = small(plan)  # it keeps its rows and their size
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        plan = materialize(_refine(sized, F.broadcast(plan) if fits else plan, shift), "mix-plan")
    plan = plan.withColumnRenamed("_source", "_plan_source")
    return sized, F.broadcast(plan) if fits else plan


def mix(docs: DataFrame, doc_id="doc_id", source="source", text="text", weights=WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    A source whose target is f times its size gives floor(f) copies of every document and one more of those with a hash
    below its threshold; the threshold is the hash at which the words taken come nearest to the target."""
    sized, plan = thresholds(docs, doc_id, source, text, weights)
    out = sized.join(plan, F.col("_source").eqNullSafe(F.col("_plan_source"))).withColumn("copies", _copies())
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with all columns of docs, and size, source_size, target, taken, copies, which replace columns
    of the same names; no text is shuffled unless there are more sources than a broadcast may hold."""
    _, plan = thresholds(docs)
    new = ("size", "source_size", "target", "taken", "copies")
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new))
    own = fresh(kept, "mix_hash", *(f"mix_{c}" for c in plan.columns))
    hash_, at = own[0], dict(zip(plan.columns, own[1:], strict=True))
    out = kept.withColumn(hash_, doc_hash(F.col("doc_id"))).join(plan.withColumnsRenamed(at), F.col("source").eqNullSafe(F.col(at["_plan_source"])))
    copies = F.col(at["_whole"]) + F.when(F.col(hash_) < F.col(at["_low"]), 1).otherwise(0)
    size = word_count(F.col("text"))
    values = (size, F.col(at["source_size"]), F.col(at["target"]), (size * copies).cast("long"), copies)
    return out.filter(copies > 0).select(*(F.col(f"`{c}`") for c in kept.columns), *(v.alias(n) for v, n in zip(values, new, strict=True)))


def _copies():
    return F.col("_whole") + F.when(F.col("_h") < F.col("_low"), 1).otherwise(0)


def _refine(sized: DataFrame, plan: DataFrame, shift: int) -> DataFrame:
    """Move each source's threshold up by whole buckets of 2^shift hashes while the budget lasts.

    Only rows in the source's open bucket, which begins at _low and is 2^(shift + LEVEL_BITS) wide, are summed. At the last
    level the bucket is one hash value, which is taken too if that brings the sum nearer to the target."""
    p = plan.select(F.col("_source").alias("_plan_source"), "_low", "_budget")
    width = 1 << (shift + LEVEL_BITS)
    inside = sized.join(p, sized["_source"].eqNullSafe(F.col("_plan_source")), "inner").filter((F.col("_h") >= F.col("_low")) & (F.col("_h") < F.col("_low") + F.lit(width)))
    bucket = F.shiftright(F.col("_h") - F.col("_low"), shift)
    found = inside.groupBy("_source", "_budget", bucket.alias("_bucket")).agg(F.sum("_size").alias("_words"))
    w = Window.partitionBy("_source").orderBy("_bucket")
    found = found.withColumn("_up_to", F.sum("_words").over(w)).withColumn("_before", F.col("_up_to") - F.col("_words"))
    if shift:
        fits = F.col("_up_to") <= F.col("_budget")
    else:
        fits = F.col("_up_to") - F.col("_budget") <= F.col("_budget") - F.col("_before")
    # the buckets that fit are a prefix; the next bucket that has rows is the open one
    after = found.groupBy("_source").agg(
        F.coalesce(F.max(F.when(fits, F.col("_up_to"))), F.lit(0)).alias("_used"),
        F.coalesce(F.min(F.when(~fits, F.col("_bucket"))), F.lit(1 << LEVEL_BITS)).alias("_next"),
    ).withColumnRenamed("_source", "_after_source")
    return plan.join(after, F.col("_source").eqNullSafe(F.col("_after_source")), "left").select(
        "_source", "source_size", "target", "_whole",
        (F.col("_budget") - F.coalesce(F.col("_used"), F.lit(0))).alias("_budget"),
        (F.col("_low") + F.coalesce(F.shiftleft(F.col("_next").cast("long"), shift), F.lit(0))).alias("_low"),
    )
