"""Queries of the text rules over whole conversations and documents. SQL can't state their patterns with look-around or
their word classes; the tests hold them against the rules of one text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import literals as L
from ..functions import policy as P
from ..functions import sequences as Q
from ..functions import text as T
from .queries import query, replies, table

#: A small lexicon of our own for the registered queries; a deployment reads its own with Lexicon.parse.
LEXICON = L.Lexicon(["API", "CI/CD", "CPU", "HTML", "JSON", "SQL", "URL"], ["JavaScript", "Node.js", "Python", "Docker"], ["React", "Swift"], ["commit", "deploy", "pull request"], {"en_to_vi": ["hello", "ok", "yes"], "vi_to_en": ["chào", "ok", "vâng"]})
POLICY = P.Policy(LEXICON)
PROTECTOR = Q.Protector([Q.Form(t, False, frozenset({"en_to_vi", "vi_to_en"})) for t in ("the", "API", "Python")])


def direction():
    return F.when(F.col("turn") % 2 == 0, "en_to_vi").otherwise("vi_to_en")


@query()
def literal_spans(spark, d):
    """Every technical literal of every document, by kind: how many, and how many characters."""
    s = table(spark, d, "documents").select("doc_id", F.explode(POLICY.spans(F.col("text"))).alias("s"))
    return s.groupBy("doc_id", F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("s.text")).alias("chars"))


@query()
def whole_literals(spark, d):
    """Distinct words that are a literal as a whole, with their kind."""
    w = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).filter("word <> ''").distinct()
    return w.select("word", POLICY.whole(F.col("word")).alias("kind")).filter("kind is not null")


@query()
def language_evidence(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", POLICY.language_evidence(F.col("text")).alias("e"))
    return x.select("conv_id", "turn", "e.*", T.language_guess(*(F.col(f"e.{n}") for n in ("marked", "plain", "shape", "english", "foreign"))).alias("guess"))


@query()
def input_decisions(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", direction().alias("direction"), T.input_normalized(F.col("text")).alias("text"))
    f = x.withColumn("f", POLICY.input_features(F.col("text"), F.col("direction")))
    return f.select("conv_id", "turn", "direction", P.decision(F.col("f"), F.col("direction")).alias("r")).select("conv_id", "turn", "direction", "r.*")


@query()
def output_checks(spark, d):
    """The assistant's text held against the user's as if it were its translation."""
    x = replies(spark, d).select("row_id", POLICY.checked(F.col("reference"), F.col("prediction"), direction()).alias("c"))
    return x.select("row_id", "c.*")


@query()
def rule_calibration(spark, d):
    """How often each rule fires, by role and direction."""
    x = input_decisions(spark, d).join(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    c = F.concat(F.array("action"), "notes", F.array(F.concat(F.lit("guess:"), F.coalesce("guess", F.lit("none")))))
    return x.select("role", "direction", F.explode(c).alias("counter")).groupBy("role", "direction", "counter").agg(F.count("*").alias("n"))


@query()
def budgeted_segments(spark, d):
    """Whole documents in segments of at most 400 characters that cut no literal at a blank."""
    spans = POLICY.literals.spans
    cut = Q._udf(lambda x: Q.policy_segments(x, lambda s: len(s) <= 400, lambda t: [(s.start, s.end) for s in spans(t)]), "array<string>")
    return table(spark, d, "documents").select("doc_id", F.posexplode(cut("text")).alias("i", "segment"))


@query()
def speakable_texts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", *(Q._udf(lambda x, g=g: Q.speakable(x, g, {"api": "ây pi ai"}), "string")("text").alias(f"said_{g}") for g in ("en", "vi")))


@query("SELECT conv_id, turn, text AS restored FROM conversations")
def placeholder_round_trip(spark, d):
    """Terms out and in again give the text."""
    return table(spark, d, "conversations").select("conv_id", "turn", Q._udf(lambda x: Q.restored(*PROTECTOR.protect(x, "en_to_vi")), "string")("text").alias("restored"))


_COUNTS = "e AS (SELECT l_orderkey, l_linenumber, l_partkey % 2 AS m, l_suppkey % 4 AS p, l_linenumber % 3 AS s, l_partkey % 5 AS e, l_orderkey % 4 AS f, l_orderkey % 2 = 0 AS src FROM lineitem)"


@query(f"""WITH {_COUNTS} SELECT l_orderkey, l_linenumber, CASE WHEN src THEN m + p > 0 AND e = 0 ELSE m + p = 0 AND e > 0 END AS hints,
m = 0 AND (p >= 2 OR (p >= 1 AND s >= 1)) AND p + s >= 2 AND p + s >= e AS unmarked FROM e""")
def language_hints(spark, d):
    e = F.struct((F.col("l_partkey") % 2).alias("marked"), (F.col("l_suppkey") % 4).alias("plain"), (F.col("l_linenumber") % 3).alias("shape"), (F.col("l_partkey") % 5).alias("english"), F.lit(False).alias("vietnamese_letter"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", e.alias("e"))
    return x.select("l_orderkey", "l_linenumber", P.hints_other_language(F.col("e"), F.col("l_orderkey") % 2 == 0).alias("hints"), P.lacks_diacritics(F.col("e")).alias("unmarked"))
