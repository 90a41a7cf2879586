"""Parallel-text release: audit, clean, deduplicate, tag, classify, split without leakage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SEED, TRAIN, VALIDATION = "42", 0.8, 0.1


def mapped(df: DataFrame, source: str, en: str, vi: str, index: str, category: str | None = None) -> DataFrame:
    """A source's columns under their common names."""
    kind = F.col(category) if category else F.lit(None).cast("string")
    return df.select(F.lit(source).alias("source_short_name"), F.col(index).cast("long").alias("raw_row_index"), F.col(en).alias("en"), F.col(vi).alias("vi"), kind.alias("category"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def audit(raw: DataFrame) -> DataFrame:
    """Counters per source, in one pass, and their totals in the row without a source."""
    text = F.col("en").isNotNull() & F.col("vi").isNotNull()
    en, vi = (F.coalesce(F.col(c), F.lit("")) for c in ("en", "vi"))
    x = raw.select("source_short_name", "en", "vi", text.alias("t"), T.clean(en).alias("ce"), T.clean(vi).alias("cv"))
    ratio = T.length_ratio(F.col("ce"), F.col("cv"))
    count = lambda c: F.count_if(c)
    per = x.groupBy("source_short_name").agg(
        F.count("*").alias("n_rows"),
        count(~F.col("t")).alias("non_string"),
        count(F.col("t") & ((F.col("ce") == "") | (F.col("cv") == ""))).alias("null_or_blank"),
        count(T.has_control(en) | T.has_control(vi)).alias("control"),
        count(F.col("t") & (F.col("ce") == F.col("cv"))).alias("identical"),
        count(F.col("t") & ((ratio > 3.5) | (ratio < 1 / 3.5))).alias("extreme_ratio"),
        count(F.col("t") & ((F.length("ce") > 1000) | (F.length("cv") > 1000))).alias("very_long"),
        count(F.col("t") & ~(T.has_letter(F.col("ce")) & T.has_letter(F.col("cv")))).alias("no_letters"),
    )
    distinct = raw.groupBy("source_short_name", "en", "vi").count().groupBy("source_short_name").agg(F.sum(F.col("count") - 1).alias("duplicates"))
    both = per.join(distinct, "source_short_name")
    sums = [F.sum(c).cast("long").alias(c) for c in both.columns[1:]]
    return both.rollup("source_short_name").agg(*sums)


def valid(raw: DataFrame) -> DataFrame:
    """Pairs with text on both sides and no control characters, cleaned."""
    ok = ~T.has_control(F.col("en")) & ~T.has_control(F.col("vi"))
    kept = raw.filter(F.col("en").isNotNull() & F.col("vi").isNotNull()).filter(ok)
    return kept.withColumn("en_clean", T.clean(F.col("en"))).withColumn("vi_clean", T.clean(F.col("vi"))).filter("en_clean <> '' and vi_clean <> ''")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def cleaned(raw: DataFrame, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Valid pairs, the first of equal ones in a source; then the category filter, so that a pair whose first copy is in a
    category left out is lost, as its later copies are gone already."""
    once = first_of(valid(raw), ["source_short_name", "en_clean", "vi_clean"], ["raw_row_index"])
    for source, allowed in (categories or {}).items():
        once = once.filter((F.col("source_short_name") != source) | F.coalesce(F.col("category").isin(allowed), F.lit(False)))
    return once


def described(pairs: DataFrame) -> DataFrame:
    x = pairs.withColumn("technical_tags", T.tags(F.col("en_clean"), F.col("vi_clean")))
    x = x.withColumn("_g", T.group_of(F.col("en_clean"), F.col("vi_clean"), F.col("technical_tags")))
    x = x.withColumn("pair_sha256", T.pair_hash(F.col("en_clean"), F.col("vi_clean")))
    return x.select("*", "_g.primary_group", "_g.group_method").drop("_g")


def keyed(pairs: DataFrame) -> DataFrame:
    x = pairs.withColumn("en_key", T.match_key(F.col("en_clean"))).withColumn("vi_key", T.match_key(F.col("vi_clean")))
    return x.withColumn("global_key", F.concat("en_key", F.lit(T.SEPARATOR), "vi_key")).withColumn("leakage_group_id", F.sha2("en_key", 256))


def ranked_copies(pairs: DataFrame) -> DataFrame:
    """copy = 1 for the first pair of a key over all sources; the rest are the removed duplicates."""
    w = Window.partitionBy("global_key").orderBy("source_short_name", "raw_row_index")
    return keyed(pairs).withColumn("copy", F.row_number().over(w))


def split_of(pairs: DataFrame) -> DataFrame:
    """(leakage_group_id, split): groups of equal English are dealt whole, by seeded hash within (source, main group)."""
    first = first_of(pairs, ["leakage_group_id"], ["source_short_name", "raw_row_index"])
    strata = Window.partitionBy("source_short_name", "primary_group")
    x = first.withColumn("_n", F.count("*").over(strata)).withColumn("_i", F.row_number().over(strata.orderBy(T.stable_rank(F.col("leakage_group_id"), SEED), "leakage_group_id")) - 1)
    a = F.greatest(F.lit(1), F.bround(F.col("_n") * TRAIN).cast("int"))
    b = F.greatest(F.lit(1), F.bround(F.col("_n") * (TRAIN + VALIDATION)).cast("int"))
    return x.select("leakage_group_id", F.when(F.col("_i") < a, "train").when(F.col("_i") < b, "validation").otherwise("it_test").alias("split"))


def release(raw: DataFrame, categories=None) -> DataFrame:
    """The released pairs: eleven columns in fixed order."""
    kept = ranked_copies(described(cleaned(raw, categories))).filter("copy = 1")
    x = kept.join(split_of(kept), "leakage_group_id")
    row_id = F.sha2(F.concat_ws(":", "source_short_name", F.col("raw_row_index").cast("string"), "global_key"), 256)
    return x.withColumn("dataset_row_id", row_id).select(
        "dataset_row_id", "split", "source_short_name", "raw_row_index", "en_clean", "vi_clean", "primary_group", "technical_tags", "group_method", "pair_sha256", "leakage_group_id"
    )


def leakage(released: DataFrame) -> DataFrame:
    """English keys and pairs that train shares with each other split: all counts must be 0."""
    k = keyed(released)
    train = k.filter("split = 'train'")
    parts = []
    for other in ("validation", "it_test"):
        o = k.filter(F.col("split") == other)
        for name, key in (("english", "en_key"), ("pair", "global_key")):
            both = train.select(key).distinct().join(o.select(key).distinct(), key, "left_semi")
            parts.append(both.agg(F.count("*").alias("shared")).select(F.lit(other).alias("split"), F.lit(name).alias("kind"), "shared"))
    return union_all(parts)


def attrition(raw: DataFrame) -> DataFrame:
    done = ranked_copies(cleaned(raw))
    return raw.agg(F.count("*").alias("raw_rows")).crossJoin(done.agg(F.count("*").alias("cleaned_rows"), F.count_if(F.col("copy") == 1).alias("released_rows")))
