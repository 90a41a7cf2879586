"""Operator 5: licence scans, with DataFrame operations only.

The units of a file are its lines, its blocks (runs of lines between lines without letters or digits, so the marks of
comments don't matter) and the whole file. Each unit is compared with every template (statements, header blocks, whole licence
files) by the cosine of sparse TF-IDF vectors; the best template from THRESHOLD on is the file's own licence.

A directory has the licence of its licence files (those so named, or marked by the caller; the highest cosine, then the
first path). Without such a file it has the licence that its licensed files share, if they are AGREE or more and name no
other. A file without a licence of its own inherits that of the nearest directory above it that has one.

IDF comes from the templates: a term of no template weighs ln(1 + templates) + 1, and one of COMMON, which any text has, next
to nothing. A unit reaches the threshold only if it has a term from some template's `marks`, the terms without which the
template's cosine with any unit stays below THRESHOLD; the rest is left out before it is split into terms, so the prefilter
loses nothing. Of what is left, a unit is shuffled only if its cosine can reach THRESHOLD when each of its other words counts
as unlike all others, which makes its norm the least (n equal words weigh n^2, n different ones n); the template terms in that
bound are counted within the row.

Defined results: null and empty texts have no licence of their own and inherit; a null path is a file named "" at the top;
equal rows give equal rows, and rows with the same key and other texts results of their own; a line of any length is one line;
ties between templates go to the first name; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small
from .licence_texts import templates as known_templates

THRESHOLD, AGREE, COMMON_IDF = 0.7, 2, 0.2
#: Words of any English text.
COMMON = frozenset(
    """a above advised agreed all also an and any appear applicable are as associated at basis be but by can caused charge claim connection deal do either
    even event except extent following for form found from has have however if in into is it its kind later like list loss made may met must name names no nor
    not obtain of on one only option or other out particular person persons possible prior purpose see shall so style such terms than that the their these this
    to under unless use used was way we what whether which who whom will with without work you your""".split()
)
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"


class Model:
    """Term weights of the templates, and their marks. names: the licence of each template, in order."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        terms = [(k, Counter(re.findall(r"[a-z0-9]+", v.lower()))) for k, vs in sorted(templates.items()) for v in vs]
        df = Counter(t for _, c in terms for t in c)
        n = len(terms)
        self.unseen = math.log(1 + n) + 1
        self.idf = {t: COMMON_IDF if t in COMMON else math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()} | {t: COMMON_IDF for t in COMMON}
        self.names, self.weights, marks, self.together = [], [], set(), []
        for name, c in terms:
            norm = math.sqrt(sum((k * self.idf[t]) ** 2 for t, k in c.items()))
            weights = {t: k * self.idf[t] / norm for t, k in c.items()}
            self.names.append(name)
            self.weights.append(weights)
            # by Cauchy-Schwarz a line with only the other terms has at most the cosine sqrt(rest)
            rest, order = 1.0, sorted(weights.items(), key=lambda x: (x[0] in COMMON, len(x[0]) < 4, df[x[0]], -x[1], x[0]))
            for i, (t, w) in enumerate(order):
                if rest < threshold**2:
                    break
                if t in COMMON and (needed := [u for u, v in order[i:] if rest - v * v < threshold**2]):
                    # the common words alone reach it only with all of these, and with enough of the others
                    self.together.append((sorted(needed), [(u, v * v) for u, v in order[i:]]))
                    break
                marks.add(t)
                rest -= w * w
        self.marks = sorted(marks)


def _units(text):
    """The lines, blocks and whole of a text, as (kind, n, words); n is 0 for the one that opens it."""
    unit = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), x.alias("words"))
    none = F.array().cast("array<struct<kind:int,n:int,words:string>>")
    lines, blocks = F.split(text, "\n"), F.split(text, r"\n(?:[^A-Za-z0-9\n]*+\n)++")
    return F.concat(
        F.transform(lines, unit(0)),
        F.when((F.size(lines) > F.size(blocks)) & (F.size(blocks) > 1), F.transform(blocks, unit(1))).otherwise(none),
        F.when(F.size(lines) > 1, F.transform(F.array(text), unit(2))).otherwise(none),
    )


def own_licences(f: DataFrame, model: Model, threshold: float) -> DataFrame:
    """row, key, path, own_licence, own_score, first: the files (row, key, path, text) that have a licence of their own."""
    spark = f.sparkSession
    marked = r"(?i)(?<![a-z0-9])(?:" + "|".join(model.marks) + r")(?![a-z0-9])"
    word = lambda c, t: c.rlike(rf"(?i)(?<![a-z0-9]){t}(?![a-z0-9])")

    def can_fit(c):
        out = c.rlike(marked) if model.marks else F.lit(False)
        for needed, terms in model.together:
            mass = reduce(lambda a, b: a + b, [F.when(word(c, t), w).otherwise(0.0) for t, w in terms])
            out = out | (reduce(lambda a, b: a & b, [word(c, t) for t in needed]) & (mass >= threshold**2 - 1e-9))
        return out

    terms_known = sorted(model.idf)
    n = len(terms_known)
    numbers = lambda xs: F.split(F.lit(",".join(map(repr, xs))), ",").cast("array<double>")  # noqa: E731  folds to one literal
    idf_at = numbers([model.idf[t] for t in terms_known])
    weight_at = numbers([w.get(t, 0.0) for w in model.weights for t in terms_known])
    known = F.split(F.lit(",".join(terms_known)), ",")
    let = lambda value, then: F.exists(F.array(value), then)  # noqa: E731  evaluates value once a row

    def reaches(every, found, counts):
        x = lambda s: s["n"] * F.get(idf_at, s["at"])
        norm = F.aggregate(counts, F.lit(0.0), lambda a, s: a + x(s) * x(s)) + model.unseen**2 * (F.size(every) - F.size(found))
        dot = lambda k: F.aggregate(counts, F.lit(0.0), lambda a, s: a + x(s) * F.get(weight_at, k * n + s["at"]))
        best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(model.weights) - 1)), dot))
        return best * best >= (threshold - 1e-6) ** 2 * norm

    one = lambda found: lambda t: F.struct((F.array_position(known, t) - 1).cast("int").alias("at"), F.size(F.filter(found, lambda o: o == t)).alias("n"))
    may_reach = lambda terms: let(terms, lambda every: let(F.filter(every, lambda t: t.isin(terms_known)), lambda found: let(F.transform(F.array_distinct(found), one(found)), lambda counts: reaches(every, found, counts))))
    terms = F.regexp_extract_all(F.translate("unit.words", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9]+"), F.lit(0))
    held = f.filter(can_fit(F.col("text"))).dropDuplicates(["row", "key", "path"])
    units = held.select("row", "key", "path", F.explode(_units(F.col("text"))).alias("unit"))
    units = units.filter(can_fit(F.col("unit.words")) & may_reach(terms)).select("row", "key", "path", "unit.kind", "unit.n", F.explode(terms).alias("term"))
    unit = ["row", "key", "path", "kind", "n"]
    counted = units.groupBy(*unit, "term").agg(F.count("*").alias("times"))
    by_term: dict[str, list] = {t: [] for t in terms_known}
    for k, weights in enumerate(model.weights):
        for t, w in weights.items():
            by_term[t].append((k, w))
    rows = [(t, model.idf[t], ws) for t, ws in sorted(by_term.items())]
    vectors = F.broadcast(spark.createDataFrame(rows, "t_term string, idf double, ws array<struct<k:int,w:double>>"))
    x = F.col("times") * F.coalesce("idf", F.lit(model.unseen))
    weighed = counted.join(vectors, F.col("term") == F.col("t_term"), "left").withColumn("x", x)
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.filter("t_term is not null").select(*unit, "x", F.explode("ws").alias("s")).groupBy(*unit, F.col("s.k").alias("k")).agg(F.sum(F.col("x") * F.col("s.w")).alias("dot"))
    norms = norms.withColumnsRenamed({c: f"n_{c}" for c in unit})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in unit])
    name = F.element_at(F.split(F.lit(",".join(model.names)), ","), F.col("k") + 1)
    scored = dots.join(norms, same).select(*unit, "k", name.alias("licence"), F.round(F.col("dot") / F.col("norm"), 9).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("row", "key", "path").agg(F.min(F.struct((-F.col("score")).alias("down"), "k", "licence")).alias("b"), F.min("n").alias("first"))
    return best.select("row", "key", "path", F.col("b.licence").alias("own_licence"), (-F.col("b.down")).alias("own_score"), "first")


def directory_licences(own: DataFrame, directory, is_file) -> DataFrame:
    """dir, dir_licence: what licence files say, or else what licensed files agree on."""
    placed = own.select(directory.alias("dir"), is_file.alias("is_file"), "path", "own_licence", "own_score")
    said = F.min(F.when(F.col("is_file"), F.struct((-F.col("own_score")).alias("down"), "path", "own_licence")))
    agreed = F.when((F.count("*") >= AGREE) & (F.min("own_licence") == F.max("own_licence")), F.min("own_licence"))
    by_dir = placed.groupBy("dir").agg(said.alias("said"), agreed.alias("agreed"))
    return by_dir.select("dir", F.coalesce("said.own_licence", "agreed").alias("dir_licence")).filter("dir_licence is not null")


def scan(files: DataFrame, templates=None, threshold=THRESHOLD, licence_file=None) -> DataFrame:
    """One row per file: key, path, own_licence, own_score, licence, inherited_from. files: key, path, text.

    licence_file: a condition on path and first (the number of the first unit with a licence; 0 opens the file)."""
    model = Model(templates or known_templates(), threshold)
    directory = F.coalesce(F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1), F.lit(""))
    f = files.select(F.xxhash64("key", "path", "text").alias("row"), "key", F.coalesce("path", F.lit("")).alias("path"), "text")
    own = materialize(own_licences(f, model, threshold), "licence-own")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    is_file = name.rlike(LICENCE_FILE) if licence_file is None else licence_file
    declared = directory_licences(own, directory, is_file).withColumnRenamed("dir", "ancestor")
    dirs = materialize(f.select(directory.alias("dir")).distinct(), "licence-dirs")
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("ancestor")).distinct()
    nearest = above.join(declared, "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "dir_licence")).alias("a"))
    near, _ = small(materialize(nearest.select(F.col("dir").alias("n_dir"), "a.ancestor", "a.dir_licence"), "licence-near"))
    o, _ = small(own.select(F.col("row").alias("o_row"), F.col("key").alias("o_key"), F.col("path").alias("o_path"), "own_licence", "own_score"))
    same = (F.col("row") == F.col("o_row")) & F.col("key").eqNullSafe(F.col("o_key")) & (F.col("path") == F.col("o_path"))
    out = f.select("row", "key", "path", directory.alias("dir")).join(o, same, "left").join(near, F.col("dir") == F.col("n_dir"), "left")
    return out.select("key", "path", "own_licence", "own_score", F.coalesce("own_licence", "dir_licence").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("ancestor")).alias("inherited_from"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """Documents as files <source>/<lang>/<doc_id>; one that opens with its licence speaks for its directory."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    files = docs.select(F.col("doc_id").alias("key"), path.alias("path"), "text")
    return scan(files, licence_file=F.col("first") == 0)
