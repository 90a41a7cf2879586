"""Operator 10: quality rules from counts within a text and from line frequency across documents.

Words are runs of characters other than blanks (space and \\x09-\\x0D). Per document: the characters in words, symbols,
lines equal to an earlier one, words in 5-word windows that occur twice. Across documents: each line is normalised (A-Z
lower-cased, blanks single), and the distinct documents of a host that have it are counted. Copies must not make a line
frequent, so documents of one near-duplicate class (operator 6), exact copies among them, count as one; a class is made of
whole texts, so no line that two documents share makes them one.
A line in more than max(MIN_DOCS, SHARE of the host's documents so counted) is boilerplate; a document is rejected when
fewer than MIN_WORDS words, or less than LEAST_LEFT of its words, are left without such lines.

Defined results: null and empty texts have no words and fail the base rule; a null host is a host of its own; equal rows
give equal results and count as one document; a line is as long as it is; an empty table gives an empty one; other columns,
of whatever name, are handed through by filtered() and ignored by judge(). Lines are counted from a table in the shared
folder and the texts read again for their classes; a frequent line needs many documents, so what is joined back is small,
and it is broadcast only if its summed bytes say so.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_join
from .common import IS_SPACE, Batch, bounded_batches, fresh, lean, materialize, mix, recount, rewritten, row_key, shingles, small, span_hash, text_pieces, utf8

MIN_WORDS, REPEAT_PERCENT = 10, 20
MIN_DOCS, SHARE, LEAST_LEFT = 20, 0.05, 0.2
SYMBOLS = np.array([chr(c) in "#*$%&|<>" for c in range(256)])
IN_WORD = ~IS_SPACE & np.array([c & 0xC0 != 0x80 for c in range(256)])  # a byte for each code point in words
CHUNK = 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def line_id(line: bytes) -> int:
    """The first 8 bytes of the MD5 of the normalised line."""
    return int.from_bytes(hashlib.md5(line).digest()[:8], "big", signed=True)


def lines_of(text: bytes) -> dict[bytes, int]:
    """Words in each normalised line, by line; lines without a word are left out."""
    out: dict[bytes, int] = {}
    for line in text.translate(_LOWER).split(b"\n"):
        if words := line.split():
            key = b" ".join(words)
            out[key] = out.get(key, 0) + len(words)
    return out


def count_rules(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base counts of each text, over all texts of a chunk at once."""
    n = len(texts)
    b = Batch(texts, ~IS_SPACE)
    out = {"n_words": b.n_words, "word_chars": b.total(IN_WORD[b.buf]), "n_symbols": b.total(SYMBOLS[b.buf])}
    ends = np.flatnonzero(b.buf == 10)  # every text ends in a newline of its own
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1]) if len(ends) else ends
    word_at = np.searchsorted(b.start, starts)
    has_word = word_at < np.searchsorted(b.start, ends)
    starts, ends = starts[has_word], ends[has_word]
    doc = np.searchsorted(b.offset, starts, side="right") - 1
    out["n_dup_lines"] = np.bincount(doc[repeats(span_hash(b.prefix, starts, ends), doc)[1]], minlength=n)
    h, at = shingles(b)
    again = at[repeats(h, b.doc[at])[0]]
    cover = np.zeros(len(b.hash) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.subtract.at(cover, again + 5, 1)
    out["n_repeat_words"] = np.bincount(b.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


def repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of values that occur twice or more in their document, and of those that an earlier one equals."""
    key = mix(h + mix(doc.astype(_U) + _U(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later = np.concatenate([np.zeros(min(1, len(key)), bool), same])
    return order[later | np.concatenate([same, np.zeros(min(1, len(key)), bool)])], order[later]


def _profile(batches):
    for b in batches:
        for begin, end, texts in text_pieces(b, 3, CHUNK):
            part = utf8(texts)
            counts = count_rules(part)
            lines = [[{"h": line_id(k), "w": v} for k, v in lines_of(t).items()] for t in part]
            s = b.slice(begin, end - begin)
            cols = [s.column(0), s.column(1), s.column(2), *(pa.array(counts[c], pa.int64()) for c in COUNTS)]
            cols += [pa.array(lines, pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "host", *COUNTS, "lines"])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def profile(docs: DataFrame, doc_id="doc_id", host="source", text="text") -> DataFrame:
    d = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    bounded_batches(d.sparkSession)
    kinds = [d.schema[c].dataType.simpleString() for c in ("doc_id", "host")]
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return d.mapInArrow(lean(_profile), f"key long, doc_id {kinds[0]}, host {kinds[1]}, {counts}, lines array<struct<h:long,w:int>>")


def with_classes(p: DataFrame, classes: DataFrame) -> DataFrame:
    """p with ident, what a document counts as: its near-duplicate class where it has others in it, else itself."""
    c = classes.filter("n_links > 0").select(F.col("key").alias("c_key"), F.col("doc_id").alias("c_id"), "class_key").distinct()
    c, _ = small(materialize(c, "rules-classes"))
    out = p.join(c, (F.col("key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left")
    return out.withColumn("ident", F.coalesce("class_key", "key")).drop("c_key", "c_id", "class_key")


def frequent_lines(p: DataFrame, min_docs=MIN_DOCS, share=SHARE) -> DataFrame:
    """(host, h): the lines above the limit. Both counts are of distinct (line, document) first, so a hot line is spread."""
    lines = p.select("host", "ident", F.explode("lines.h").alias("h")).distinct()
    often = lines.groupBy("host", "h").agg(F.count("*").alias("docs")).filter(F.col("docs") > min_docs)
    hosts = p.filter("size(lines) > 0").select("host", "ident").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    hosts = hosts.withColumnRenamed("host", "its_host")
    return often.join(hosts, F.col("host").eqNullSafe(F.col("its_host"))).filter(F.col("docs") > share * F.col("host_docs")).select("host", "h")


def judge(docs: DataFrame, doc_id="doc_id", host="source", text="text") -> tuple[DataFrame, DataFrame]:
    """(verdicts: key, doc_id, the counts, base_failed, left_words, kept; removals: key, doc_id, hashes of lines to remove)."""
    p = materialize(profile(docs, doc_id, host, text), "rules-profile")
    told_apart = with_classes(p.select("key", "doc_id", "host", "lines"), jaccard_join.classes(docs, doc_id, text))
    often, fits = small(materialize(frequent_lines(told_apart), "rules-lines").withColumnRenamed("host", "line_host"))
    own = p.select("key", "doc_id", "host", F.explode("lines").alias("l")).select("key", "doc_id", "host", "l.h", "l.w")
    often = often.withColumnRenamed("h", "line_h")
    hit = own.join(often, (F.col("h") == F.col("line_h")) & F.col("host").eqNullSafe(F.col("line_host")))
    hit = hit.groupBy("key", "doc_id", "h").agg(F.max("w").alias("w")).groupBy("key", "doc_id")
    removals = materialize(hit.agg(F.sum("w").alias("removed"), F.collect_list("h").alias("hashes")), "rules-removals")
    r, _ = small(removals.select(F.col("key").alias("r_key"), F.col("doc_id").alias("r_id"), "removed"))
    v = p.drop("lines", "host").join(r, (F.col("key") == F.col("r_key")) & F.col("doc_id").eqNullSafe(F.col("r_id")), "left")
    left = F.col("n_words") - F.coalesce(F.col("removed"), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("removed").isNotNull() & ((left < MIN_WORDS) | (left < LEAST_LEFT * F.col("n_words")))
    verdicts = v.select("key", "doc_id", *COUNTS, failed.alias("base_failed"), left.alias("left_words"), (~failed & ~depleted).alias("kept"))
    return verdicts, removals


def without_lines(text: str | None, hashes) -> str | None:
    """text without the lines whose normalised form has one of the hashes."""
    if text is None or not hashes:
        return text
    gone = set(hashes)
    keep = [x for x in text.split("\n") if not (w := x.encode("utf-8", "surrogatepass").translate(_LOWER).split()) or line_id(b" ".join(w)) not in gone]
    return "\n".join(keep)


def _strip(text: str):
    def run(batches):
        for b in batches:
            hashes, rest = b.column(b.num_columns - 1), pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1])
            change = lambda texts, x, y, h=hashes: [without_lines(t, k) for t, k in zip(texts, h.slice(x, y - x).to_pylist(), strict=True)]
            yield from rewritten(rest, text, CHUNK, change)

    return lean(run)


def filtered(docs: DataFrame, host="source") -> DataFrame:
    """docs that pass, without their boilerplate lines, with the columns of docs (n_chars counts the new text)."""
    verdicts, removals = judge(docs, host=host)
    key, bad_key, bad_id, line_key, line_id_, hashes = fresh(docs, "row_key", "bad_key", "bad_id", "line_key", "line_id", "line_hashes")
    bad = materialize(verdicts.filter("not kept").select(F.col("key").alias(bad_key), F.col("doc_id").alias(bad_id)).distinct(), "rules-bad")
    bad, _ = small(bad)
    lines, _ = small(removals.select(F.col("key").alias(line_key), F.col("doc_id").alias(line_id_), F.col("hashes").alias(hashes)))
    d = docs.withColumn(key, row_key())
    d = d.join(bad, (F.col(key) == F.col(bad_key)) & F.col("doc_id").eqNullSafe(F.col(bad_id)), "left_anti")
    d = d.join(lines, (F.col(key) == F.col(line_key)) & F.col("doc_id").eqNullSafe(F.col(line_id_)), "left")
    return recount(d.select(*(F.col(f"`{c}`") for c in docs.columns), hashes).mapInArrow(_strip("text"), docs.schema), docs)
