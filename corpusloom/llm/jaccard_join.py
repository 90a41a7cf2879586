"""Operator 6: similarity join on the Jaccard index of 5-word shingles, with Bayesian pruning of candidates.

1. Texts with equal shingle sets are one node (128-bit hash of the set), so copies never meet each other.
2. MinHash values are banded; nodes that share a band are candidates. With 24 bands of 4 a pair at the threshold is missed
   with probability (1 - 0.8^4)^24, 3 in a million.
3. Candidates' MinHash values are compared 16 at a time. After each step the posterior probability, from a flat prior, that
   the similarity reaches the threshold is known from the matches so far; a pair for which it is below TOLERANCE is dropped.
4. Surviving pairs only make clusters (a spanning forest of each bucket, so what is written stays linear). Each cluster's
   members get their whole shingle sets, candidates in it are pruned as in 3, and the rest verified exactly.

Buckets and clusters above a block's size are dealt into blocks, and each pair of blocks is a group of its own, so no task
holds an unbounded group; groups are read as a sorted stream. Pairs are never rows: a group returns, for each member, how
many texts it is linked to and the root of its links.

Words are runs of a-z (A-Z lower-cased), 0-9 and non-ASCII characters. A text of 1 to 4 words has one shingle, all its words.

Defined results: null and empty texts, and those without words, are alone in their class with no links; a class's id is its
least doc_id (null only if all are null); rows with equal text are copies of each other, whatever their ids; the order of
rows doesn't matter; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_LETTER, LETTERS, Batch, bounded_batches, fresh, lean, materialize, mix, row_key, sequence_hash, shingles, small, text_pieces, utf8
from .graph import components

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
ROWS, BANDS, STEP = 4, 24, 16
HASHES = ROWS * BANDS
BLOCK = 256
CHUNK = 1 << 18
PAIRS = 1 << 16
_U = np.uint64
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(n: int, threshold=THRESHOLD, tolerance=TOLERANCE) -> int:
    """The fewest matches of n MinHash values at which P(similarity >= threshold | matches) is at least tolerance.

    With a flat prior the posterior is Beta(m + 1, n - m + 1); its upper tail is a binomial sum."""
    for m in range(n + 1):
        tail = sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        if tail >= tolerance:
            return m
    return n


LEAST = {n: least_matches(n) for n in range(STEP, HASHES + 1, STEP)}


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (lower-cased bytes)."""
    b = Batch(texts, IS_LETTER)
    h, at = shingles(b, SHINGLE)
    first = np.searchsorted(b.doc[at], np.arange(len(texts) + 1))
    out = []
    for i, n in enumerate(b.n_words):
        if n >= SHINGLE:
            out.append(np.unique(h[first[i] : first[i + 1]]))
        elif n:
            out.append(sequence_hash(b.hash[b.first[i] : b.first[i + 1]]))
        else:
            out.append(np.zeros(0, _U))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    x, out = (s >> _U(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, ((x[i : i + 2048, None] ^ _XOR) * _MUL).min(axis=0), out=out)
    return out


def node_of(s: np.ndarray) -> bytes | None:
    """128 bits of the set, in any order."""
    return None if not len(s) else mix(s).sum().tobytes() + mix(s ^ _U(0x5851F42D4C957F2D)).sum().tobytes()


def _sets(b, column):
    for begin, end, texts in text_pieces(b, column, CHUNK):
        yield begin, end, shingle_sets([t.translate(LETTERS) for t in utf8(texts)])


def _sign(batches):
    for b in batches:
        for begin, end, sets in _sets(b, 2):
            s = b.slice(begin, end - begin)
            nodes = pa.array([node_of(x) for x in sets], pa.binary())
            signs = pa.array([signature(x).tobytes() if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), nodes, signs], ["key", "doc_id", "node", "sign"])


def _set_rows(batches):
    for b in batches:
        for begin, end, sets in _sets(b, 0):
            full = [x for x in sets if len(x)]
            cols = [pa.array([f(x) for x in full], pa.binary()) for f in (node_of, lambda x: signature(x).tobytes(), lambda x: x.tobytes())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "sign", "shingles"])


def survivors(signs: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Indices of the pairs that the posterior keeps, over ever more of the MinHash values."""
    live, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        matches += (signs[i[live], n - STEP : n] == signs[j[live], n - STEP : n]).sum(axis=1, dtype=np.int32)
        ok = matches >= LEAST[n]
        live, matches = live[ok], matches[ok]
        if not len(live):
            break
    return live


def first_meeting(signs: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Indices of the pairs that share no band before the given one: each pair is looked at in one bucket only."""
    live = np.arange(len(i))
    for k in range(int(band.max(initial=0))):
        part = slice(ROWS * k, ROWS * (k + 1))
        live = live[(band[live] <= k) | (signs[i[live], part] != signs[j[live], part]).any(axis=1)]
    return live


def group_pairs(block: np.ndarray):
    """Pairs of a group: in a group of one block all, in one of two blocks those across."""
    if block.min() == block.max():
        return np.triu_indices(len(block), 1)
    a, b = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    return np.repeat(a, len(b)), np.tile(b, len(a))


def groups(batches, names):
    """Consecutive rows with equal names as record batches; a group may span Arrow batches."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
        if not t.num_rows:
            continue
        keys = [t.column(n).to_numpy() for n in names]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        last = int(change[-1]) if len(change) else 0
        if last:
            yield t.slice(0, last), np.concatenate([[0], change[:-1]]), change
        rest = t.slice(last).combine_chunks().to_batches()[0]
    if rest is not None and rest.num_rows:
        t = pa.Table.from_batches([rest])
        yield t, np.array([0]), np.array([t.num_rows])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


class Roots(dict):
    def root(self, x):
        while (y := self.get(x, x)) != x:
            self[x] = x = self.get(y, y)
        return x


def _candidate_forest(batches):
    for t, begins, ends in groups(batches, ["bucket", "lo", "hi"]):
        signs, nodes, block = _matrix(t.column("sign")), t.column("node").to_pylist(), t.column("block").to_numpy()
        band = t.column("band").to_numpy()
        out, pi, pj, waiting = set(), [], [], 0

        def flush():
            if pi:
                i, j = np.concatenate(pi), np.concatenate(pj)
                new = first_meeting(signs, i, j, band[i])
                i, j = i[new], j[new]
                roots = Roots()
                for k in survivors(signs, i, j).tolist():
                    a, b = roots.root(nodes[i[k]]), roots.root(nodes[j[k]])
                    if a != b:
                        roots[max(a, b)] = min(a, b)
                        out.add((min(a, b), max(a, b)))
                pi.clear(), pj.clear()

        for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
            if y - x < 2:
                continue
            i, j = group_pairs(block[x:y])
            pi.append(i + x), pj.append(j + x)
            waiting += len(i)
            if waiting >= PAIRS:
                flush()
                waiting = 0
        flush()
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _verify(batches):
    for t, begins, ends in groups(batches, ["cluster", "lo", "hi"]):
        signs, nodes, block = _matrix(t.column("sign")), t.column("node").to_pylist(), t.column("block").to_numpy()
        sets = [np.frombuffer(x, _U) for x in t.column("shingles").to_pylist()]
        copies, links, roots = t.column("copies").to_numpy(), np.zeros(len(nodes), np.int64), Roots()
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
            if y - x < 2:
                continue
            i, j = group_pairs(block[x:y])
            i, j = i + x, j + x
            near = np.minimum(sizes[i], sizes[j]) >= THRESHOLD * np.maximum(sizes[i], sizes[j])
            i, j = i[near], j[near]
            for k in survivors(signs, i, j).tolist():
                p, q = i[k], j[k]
                a, b = (sets[p], sets[q]) if sizes[p] <= sizes[q] else (sets[q], sets[p])
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                common = int((b[at] == a).sum())
                if common >= THRESHOLD * (len(a) + len(b) - common):
                    links[p] += copies[q]
                    links[q] += copies[p]
                    u, v = roots.root(nodes[p]), roots.root(nodes[q])
                    if u != v:
                        roots[max(u, v)] = min(u, v)
        at = np.flatnonzero(links)
        if len(at):
            cols = [pa.array([nodes[k] for k in at], pa.binary()), pa.array(links[at]), pa.array([roots.root(nodes[k]) for k in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "links", "root"])


def dealt(rows: DataFrame, group: str, count: str, block: int = BLOCK) -> DataFrame:
    """rows with block, lo, hi: a group of up to `block` is one group; a larger one is dealt into blocks, a group per pair."""
    n = F.ceil(F.col(count) / F.lit(block)).cast("int")
    r = rows.withColumn("_n", n).withColumn("block", F.pmod(F.xxhash64("node", group), F.col("_n")).cast("int"))
    r = r.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return r.withColumn("lo", F.least("block", "_other").cast("int")).withColumn("hi", F.greatest("block", "_other").cast("int")).drop("_n", "_other")


def stream(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group together and in order, to be read as a stream."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def classes(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """key, doc_id, node, class_id, class_key (of the row that stands for the class), n_links: a row per document."""
    d = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    bounded_batches(d.sparkSession)
    signed = materialize(d.mapInArrow(lean(_sign), f"key long, doc_id {kind}, node binary, sign binary"), "join-signs")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("rep")
    by_node = signed.filter("node is not null").groupBy("node").agg(rep, F.count("*").alias("copies"), F.max("sign").alias("sign"))
    nodes = materialize(by_node, "join-nodes")
    keys = F.array(*(F.xxhash64(F.substring("sign", 1 + 4 * ROWS * i, 4 * ROWS), F.lit(i)) for i in range(BANDS)))
    banded = nodes.select("node", F.posexplode(keys).alias("band", "bucket"))
    counts = banded.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    shared = materialize(banded.join(counts, "bucket"), "join-buckets")
    signs = nodes.select("node", "sign")
    groups_ = dealt(shared.join(signs, "node"), "bucket", "members")
    forest = stream(groups_, ["bucket", "lo", "hi"]).select("bucket", "lo", "hi", "block", "band", "node", "sign").mapInArrow(lean(_candidate_forest), "a binary, b binary")
    clusters = components(forest).withColumnRenamed("label", "cluster_node")
    sizes = clusters.groupBy("cluster_node").agg(F.count("*").alias("members"))
    clusters = clusters.join(sizes, "cluster_node").join(nodes.select("node", "copies", "rep"), "node")
    clusters = materialize(clusters.select("node", F.xxhash64("cluster_node").alias("cluster"), "members", "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.key").alias("rep_key")), "join-clusters")
    wanted, _ = small(clusters.select(F.col("rep_id").alias("w_id"), F.col("rep_key").alias("w_key")))
    texts = d.join(wanted, (F.col("key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi").select("text")
    sets = texts.mapInArrow(lean(_set_rows), "node binary, sign binary, shingles binary")
    members = sets.join(clusters.select("node", "cluster", "members", "copies"), "node").dropDuplicates(["node"])
    checked = stream(dealt(members, "cluster", "members"), ["cluster", "lo", "hi"])
    checked = checked.select("cluster", "lo", "hi", "block", "node", "sign", "shingles", "copies").mapInArrow(lean(_verify), "node binary, links long, root binary")
    linked = materialize(checked, "join-links")
    total = linked.groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
    label = components(linked.select("node", "root"), "node", "root").withColumnRenamed("node", "c_node")
    of_node = nodes.select("node", "rep", "copies").join(label, F.col("node") == F.col("c_node")).join(total, F.col("node") == F.col("l_node"))
    of_label = of_node.groupBy(F.col("label").alias("t_label")).agg(F.min("rep").alias("top"))
    joined = of_node.join(of_label, F.col("label") == F.col("t_label")).select("node", F.col("top").alias("rep"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    alone = nodes.filter("copies > 1").join(label, F.col("node") == F.col("c_node"), "left_anti").select("node", "rep", (F.col("copies") - 1).alias("n_links"))
    special, _ = small(materialize(joined.unionByName(alone).withColumnRenamed("node", "s_node"), "join-classes"))
    out = signed.select("key", "doc_id", "node").join(special, F.col("node") == F.col("s_node"), "left")
    has = F.col("s_node").isNotNull()
    return out.select(
        "key", "doc_id", "node",
        F.when(has, F.col("rep.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(has, F.col("rep.key")).otherwise(F.col("key")).alias("class_key"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id, with all columns of docs; of equal rows any one. Documents
    without words are no copies of each other and all stay."""
    c = materialize(classes(docs), "dedup-classes")
    row, gone_key, gone_id, twice_key, twice_id, n = fresh(docs, "row_key", "gone_key", "gone_id", "twice_key", "twice_id", "n_rows")
    keep = (F.col("key") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone, _ = small(materialize(c.filter(~keep).select(F.col("key").alias(gone_key), F.col("doc_id").alias(gone_id)).distinct(), "dedup-gone"))
    twice = c.filter(keep & F.col("node").isNotNull()).groupBy(F.col("key").alias(twice_key), F.col("doc_id").alias(twice_id)).agg(F.count("*").alias(n))
    twice, _ = small(materialize(twice.filter(F.col(n) > 1).drop(n), "dedup-twice"))
    d = docs.withColumn(row, row_key())
    d = d.join(gone, (F.col(row) == F.col(gone_key)) & F.col("doc_id").eqNullSafe(F.col(gone_id)), "left_anti")
    same = (F.col(row) == F.col(twice_key)) & F.col("doc_id").eqNullSafe(F.col(twice_id))
    once = d.join(twice, same, "left_anti")
    return once.unionByName(d.join(twice, same, "left_semi").dropDuplicates([row, "doc_id"])).select(*(F.col(f"`{c}`") for c in docs.columns))
