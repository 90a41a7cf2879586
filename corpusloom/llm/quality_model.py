"""Operator 3: quality classifier, a generalised additive model with pairwise interactions.

Each text gives a few features (shares of kinds of characters, repetition, lengths). They are cut into bins at quantiles of
the training rows. Boosting goes round the features in turn: on each, a tree of at most LEAVES leaves over the feature's
bins is fitted to the residuals and added to that feature's lookup table; then the pairs of features that explain most of
what is left get tables over coarse bins of both. A score is the sum of the tables' entries, a vectorised addition per bin.

Training rows: labelled documents whose crc32 of the id as text, modulo 3, is not 1; of each label the TRAIN_ROWS with the
least MD5 of the id (the documented bound of the sample), weighed so that the labels keep their shares. Every document is
scored. The label, language, source and id are no features.

Defined results: null and empty texts have all features 0 and a score; null labels and labels without a document are
ignored, repeated ones count repeatedly, as do rows
that share a labelled id (those of the least key first, so reruns agree); without usable labels every score is 0.5; equal texts have equal scores; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Batch, bounded_batches, lean, materialize, mix, row_key, span_hash, text_pieces, utf8

TRAIN_ROWS = 20_000
BINS, PAIR_BINS, LEAVES, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAST_WEIGHT = 48, 8, 4, 150, 60, 8, 0.15, 20.0
CHUNK = 1 << 18
_U = np.uint64
_CLASS = {
    "upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&<>", "bar": b"|", "bang": b"!?", "stop": b".,;:", "high": range(128, 256),
}
FEATURES = (
    "log_words", "word_length", *(f"{k}_share" for k in _CLASS), "upper_words", "distinct_share", "top_share", "same_as_last", "repeated_pairs",
    "words_per_line", "repeated_lines", "bare_words",
)


def features(texts: list[bytes]) -> np.ndarray:
    """(texts, FEATURES) over whole texts."""
    n = len(texts)
    b = Batch(texts, ~IS_SPACE)
    size = np.maximum(np.diff(b.offset) - 1, 1).astype(float)
    words = np.maximum(b.n_words, 1).astype(float)
    per_word = lambda flags, doc=b.doc: np.bincount(doc, weights=flags, minlength=n) / words
    table = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASS.items()}
    lengths = (b.end - b.start).astype(float)
    out = [np.log1p(b.n_words), per_word(lengths), *(b.total(t[b.buf]) / size for t in table.values())]
    upper = np.concatenate([np.zeros(1, np.int64), np.cumsum(table["upper"][b.buf], dtype=np.int32)])
    out.append(per_word((upper[b.end] - upper[b.start]) * 2 > lengths))
    key = mix(b.hash + mix(b.doc.astype(_U) + _U(1)))
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    out.append(np.bincount(b.doc[at], minlength=n) / words)
    top = np.zeros(n)
    np.maximum.at(top, b.doc[at], count)
    out.append(top / words)
    same = np.concatenate([np.zeros(min(1, len(key)), bool), key[1:] == key[:-1]])
    out.append(per_word(same))
    pair = np.concatenate([mix(key[:-1] * _U(3) + key[1:]), key[-1:]])
    _, at = np.unique(pair, return_index=True)
    out.append(1 - np.bincount(b.doc[at], minlength=n) / words)
    out[-1][b.n_words == 0] = 0
    ends = np.flatnonzero(b.buf == 10)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])[: len(ends)]
    first, last = np.searchsorted(b.start, starts), np.searchsorted(b.start, ends)
    full = last > first
    line_doc = b.doc[first[full]]
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    out.append(b.n_words / lines)
    h = mix(span_hash(b.prefix, starts[full], ends[full]) + mix(line_doc.astype(_U) + _U(1)))
    _, at = np.unique(h, return_index=True)
    out.append(1 - np.maximum(np.bincount(line_doc[at], minlength=n), 1) / lines)
    letters = table["upper"] | np.isin(np.arange(256), list(range(97, 123))) | table["high"]
    some = np.concatenate([np.zeros(1, np.int64), np.cumsum(letters[b.buf], dtype=np.int32)])
    out.append(per_word(some[b.end] == some[b.start]))
    return np.nan_to_num(np.stack(out, 1)).astype(np.float32)


def _featurise(batches):
    for b in batches:
        for begin, end, texts in text_pieces(b, 2, CHUNK):
            x = features(utf8(texts))
            s = b.slice(begin, end - begin)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), flat], ["key", "doc_id", "x"])


class Model:
    def __init__(self):
        self.base, self.cuts, self.tables, self.pairs = 0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), []

    def bins(self, x):
        return [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]

    def raw(self, x):
        bins = self.bins(x)
        out = np.full(len(x), self.base)
        for t, b in zip(self.tables, bins, strict=True):
            out += t[b]
        for f, g, cf, cg, t in self.pairs:
            out += t[cf[bins[f]], cg[bins[g]]]
        return out

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g, h, weight, leaves=LEAVES):
    """Values per bin of a tree of at most `leaves` leaves over bins with gradient sums g, hessian sums h and weights."""
    edges = [(0, len(g))]
    cg, ch, cw = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, weight))
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(edges):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = _gain(cg[m] - cg[a], ch[m] - ch[a]) + _gain(cg[b] - cg[m], ch[b] - ch[m]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                gain[(cw[m] - cw[a] < LEAST_WEIGHT) | (cw[b] - cw[m] < LEAST_WEIGHT)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), k, int(m[gain.argmax()]))
        if best[1] is None:
            break
        a, b = edges.pop(best[1])
        edges += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in edges:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _coarse(counts):
    """Each bin's coarse bin: runs of bins with about equal weight."""
    share = (np.cumsum(counts) - counts / 2) / max(counts.sum(), 1e-9)
    return np.minimum((share * PAIR_BINS).astype(int), PAIR_BINS - 1)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    m = Model()
    if not len(y) or y.min() == y.max():
        m.base = 0.0 if not len(y) else 6.0 if y[0] else -6.0
        return m
    m.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    bins = m.bins(x)
    sums = [np.bincount(b, weights=weight, minlength=len(t)) for b, t in zip(bins, m.tables, strict=True)]
    p = np.average(y, weights=weight)
    m.base = float(np.log(p / (1 - p)))
    raw = np.full(len(y), m.base)

    def residual():
        q = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return weight * (y - q), weight * q * (1 - q)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = residual()
            n = len(m.tables[f])
            step = RATE * np.clip(_tree(np.bincount(b, g, n), np.bincount(b, h, n), sums[f]), -4, 4)
            m.tables[f] += step
            raw += step[b]
    coarse = [_coarse(s) for s in sums]
    g, h = residual()
    ranked = []
    for f in range(len(bins)):
        for k in range(f):
            cell = coarse[f][bins[f]] * PAIR_BINS + coarse[k][bins[k]]
            size = PAIR_BINS * PAIR_BINS
            ranked.append((float(_gain(np.bincount(cell, g, size), np.bincount(cell, h, size)).sum()), f, k))
    for _, f, k in sorted(ranked, reverse=True)[:PAIRS]:
        m.pairs.append((f, k, coarse[f], coarse[k], np.zeros((PAIR_BINS, PAIR_BINS))))
    for _ in range(PAIR_ROUNDS):
        for f, k, cf, ck, t in m.pairs:
            g, h = residual()
            cell = cf[bins[f]] * PAIR_BINS + ck[bins[k]]
            gs, hs, ws = (np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h, weight))
            # split on the first feature, then each part on the second
            top = _tree(gs.sum(1), hs.sum(1), ws.sum(1), 2)
            step = np.zeros_like(t)
            for value in np.unique(top):
                rows = top == value
                step[rows] = _tree(gs[rows].sum(0), hs[rows].sum(0), ws[rows].sum(0), 2)
            step = RATE * np.clip(step, -4, 4)
            t += step
            raw += step.ravel()[cell]
    return m


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(featured: DataFrame, labels: DataFrame, label="quality", rows=TRAIN_ROWS) -> Model:
    lab = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("y")).filter("l_id is not null and y in (0, 1)").filter(~held_out(F.col("l_id")))
    counts = {r.y: r["count"] for r in lab.groupBy("y").count().collect()}
    xs, ys, ws = [], [], []
    for y in (0, 1):
        picked = lab.filter(F.col("y") == y).select("l_id", "y", F.md5(F.col("l_id").cast("string").cast("binary")).alias("_o")).orderBy("_o", "l_id").limit(rows)
        got = featured.join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("_o", "key", "x").orderBy("_o", "key").limit(rows).collect()
        if got:
            xs.append(np.array([r.x for r in got], np.float32))
            ys.append(np.full(len(got), y))
            ws.append(np.full(len(got), counts[y] / len(got)))
    if not xs:
        return Model()
    w = np.concatenate(ws)
    return fit(np.concatenate(xs), np.concatenate(ys), w / w.mean())


def classify(docs: DataFrame, labels: DataFrame, label="quality", doc_id="doc_id", text="text", rows=TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    d = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    bounded_batches(d.sparkSession)
    featured = materialize(d.mapInArrow(lean(_featurise), f"key long, doc_id {kind}, x array<float>"), "quality-features")
    model = train(featured, labels, label, rows)

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).flatten(), np.float32).reshape(-1, len(FEATURES))
            score = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    scored = featured.select("doc_id", "x").mapInArrow(lean(run), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
