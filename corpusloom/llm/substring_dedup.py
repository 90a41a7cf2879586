"""Operator 9: near-duplicate passages by compact windows.

A passage is LENGTH words or more. The tokens are 5-word shingles; HASHES hash functions each give a token a value. For one
function, the Cartesian tree over a text's values has a node for each token c; the subsequences [i, j] with l <= i <= c <=
j <= r, between the nearest smaller values on both sides, all have c's value as their least: they are one compact window.
Only windows that hold a whole passage matter. Their tokens are exactly the minima of sliding windows of that length, so
those are found first, with running minima, and the tree stands over them alone.

Windows with the same function and value are grouped. Starts of passage-long subsequences where windows of ENOUGH functions are
shared with any other text are candidates; whom they are shared with is not asked here, so no partner can be left out.

Candidates are verified on whole texts, exactly: a word is in a passage if it lies between the first and the last of NEED
(THRESHOLD of TOKENS) or more shingles of a subsequence of TOKENS that one and the same other text's candidates have. That is
the union over all other texts, so it is enough to know, for each word, one text that covers it:

* Equal texts are one text from the start; a text that is there under several ids is repeated in whole.
* Shingles with the same value are grouped, and each row learns up to six witnesses: the texts whose key is least and greatest
  in the group by the key's upper and by its lower half, and its neighbours in the order of the upper half. What the witnesses
  cover is settled. They only save work.
* A subsequence with NEED shared shingles that isn't settled is open. If two texts have the same shared shingles in theirs, each
  covers the other's.
* Open shingles are counted exactly among all candidates' texts. A stretch with shingles that more than WIDE texts have is
  compared with up to LANES of these texts first, the same ones for all stretches of a group of near copies; what they cover is
  settled too, so large groups need not meet in all pairs. These only save work as well.
* For what is still open all partners are looked at. A text with NEED of m shared shingles has one at least of any m - NEED + 1
  of them; and if the settled words leave no gap in the middle, it adds words only if it has a shingle that isn't settled. The
  cheaper of the two sets is looked up among all candidates' shingles, without a limit (shingles that the very same texts have
  once), and the texts so found are compared with the open shingles. What a bitmap of open hashes lets through is compared in
  full, so it may be as full as it likes.

A value that HOT documents of one batch have, or several often, would gather in one task; of such a value a batch sends one row to its group, and
the others are spread and take as witnesses the first and last document of the batch that has it.

Defined results: null, empty and short texts have no passages; repeats within one document, and rows equal in id and text,
are not repeats across documents; texts equal under other ids are; empty tables give empty results; other columns are
ignored. Words are runs of a-z (A-Z lower-cased), 0-9 and non-ASCII characters; spans count them from 0, end excluded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_LETTER, LETTERS, Batch, bounded_batches, lean, materialize, mix, row_key, shingles, small, text_pieces, utf8
from .jaccard_join import groups, stream

SHINGLE, LENGTH, THRESHOLD = 5, 50, 0.8
TOKENS = LENGTH - SHINGLE + 1
NEED = int(np.ceil(THRESHOLD * TOKENS))
HASHES, ENOUGH = 6, 2
HOT = 8
CHUNK = 1 << 18
_U = np.uint64
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_HALF = np.int64(0xFFFFFFFF)
ROWS = "route long, key long, payload long, first long, last long, spread boolean"
#: Columns of two witnesses each, and whether these are upper (0) or lower halves (1) of keys.
WITNESSES = {"ends": 0, "others": 1, "beside": 0}
LIST = "array<struct<start:int,end:int>>"
SPANS = f"key long, spans {LIST}"
#: The function's number in rows that hold a text's number of words.
WORDS = 15
#: Words of 64 bits in the bitmap of open hashes.
BITMAP_BITS = 19
#: A stretch with shingles that more texts than WIDE have is compared with one text for each of LANES orders of keys first.
WIDE, LANES = 64, 16
_LANES = mix(np.arange(1, LANES + 1, dtype=_U)).view(np.int64)
SALTS = 16
_WIDE = 1 << 31


def sliding(values: np.ndarray, length: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each run of `length` values, by doubling."""
    reach, out = 1, values
    while reach * 2 <= length:
        out = least(out[:-reach], out[reach:])
        reach *= 2
    return least(out[: len(out) - (length - reach)], out[length - reach :]) if reach < length else out


def nearest(values: np.ndarray, smaller) -> np.ndarray:
    """For each value the nearest index to the left whose value is `smaller` than it, or -1: edges of the Cartesian tree."""
    left = np.arange(len(values)) - 1
    open_ = np.arange(len(values))
    while len(open_):
        open_ = open_[left[open_] >= 0]
        open_ = open_[~smaller(values[left[open_]], values[open_])]
        left[open_] = left[left[open_]]
    return left


def compact_windows(values: np.ndarray, length: int = TOKENS):
    """(c, l, r) of the windows of at least `length` tokens; of equal values the leftmost is the least."""
    n = len(values)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    low = sliding(values, length, np.minimum)
    pad = np.zeros(length - 1, values.dtype)
    c = np.flatnonzero(sliding(np.concatenate([pad, low, pad]), length, np.maximum) == values)
    v = values[c]
    left = nearest(v, np.less_equal)
    right = len(v) - 1 - nearest(v[::-1], np.less)[::-1]
    l = np.where(left >= 0, c[left] + 1, 0)  # noqa: E741
    r = np.where(right < len(v), c[np.minimum(right, len(v) - 1)] - 1, n - 1)
    ok = r - l + 1 >= length
    return c[ok], l[ok], r[ok]


def _spread(value, docs, payload):
    """The route of a hot value's row from its value; and its value from the route."""
    return value ^ mix(docs.view(_U) + payload.astype(_U))


def _rows(key, docs, payload):
    """The rows of a batch, in order: route, the document's key, payload, and for hot values the first and the last document of
    the batch that has them. Rows are routed by their value, but for all rows of a hot value after its first."""
    order = np.lexsort((docs, key))
    k, d = key[order], docs[order]
    some = np.ones(min(1, len(k)), bool)
    new = np.concatenate([some, k[1:] != k[:-1]])
    of = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(k)]])[: len(begin)]
    others = np.bincount(of, weights=new | np.concatenate([some, d[1:] != d[:-1]]), minlength=len(begin))
    hot = ((others >= HOT) | ((others > 1) & (end - begin >= 4 * HOT)))[of]
    spread, first, last = np.zeros(len(k), bool), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    spread[order], first[order], last[order] = hot & ~new, np.where(hot, d[begin][of], 0), np.where(hot, d[end - 1][of], 0)
    route = np.where(spread, _spread(key, docs, payload), key)
    witness = lambda x: pa.array(x, pa.int64(), mask=x == 0)
    return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(docs), pa.array(payload), witness(first), witness(last), pa.array(spread)], ["route", "key", "payload", "first", "last", "spread"])


def _runs(value, doc, begin, end):
    """Start intervals of a document that follow each other with the same value made one (a text that repeats itself has many)."""
    order = np.argsort(begin, kind="stable")
    value, doc, begin, end = value[order], doc[order], begin[order], end[order]
    new = np.concatenate([np.ones(min(1, len(value)), bool), (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] != end[:-1] + 1)])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(value) - 1]])[: len(at)]
    return value[at], doc[at], begin[at], end[last]


def _windows(batches):
    for b in batches:
        ids = b.column(0).to_numpy()
        for begin, end, texts in text_pieces(b, 1, CHUNK):
            w = Batch([t.translate(LETTERS) for t in utf8(texts)], IS_LETTER)
            h, at = shingles(w, SHINGLE)
            doc = w.doc[at]
            first = np.searchsorted(doc, np.arange(end - begin + 1))
            out = []
            for k in range(HASHES):
                v = mix(h ^ _SEEDS[k]) | _U(1)
                # a text's first token begins a new sequence: windows over an edge are cut at it below
                c, l, r = _cut(v, first, doc)
                lo, hi = np.maximum(l, c - TOKENS + 1), np.minimum(c, r - TOKENS + 1)
                value, d, lo, hi = _runs(mix(v[c] + _U(k)), doc[c], lo, hi)
                out.append((value, d, (lo - first[d]) << 32 | (hi - lo) << 4 | k))
            long_ = np.flatnonzero(w.n_words >= LENGTH)
            out.append((mix(ids[begin:end][long_].view(_U)), long_, w.n_words[long_] << 4 | WORDS))
            key, d, payload = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.argsort(d, kind="stable")
            yield _rows(key[order], ids[begin:end][d[order]], payload[order])


def _cut(v, first, doc):
    """compact_windows of each text of a chunk, in one go: a value below all others stands between texts."""
    n = len(v)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    spaced = np.zeros(n + len(first) - 1, _U)
    place = np.arange(n) + doc
    spaced[place] = v
    back = np.zeros(len(spaced), np.int64)
    back[place] = np.arange(n)
    if len(spaced) < TOKENS:
        return (np.zeros(0, np.int64),) * 3
    c, l, r = compact_windows(spaced)
    ok = spaced[c] > 0
    return back[c[ok]], back[l[ok]], back[r[ok]]


def _shared(rows: DataFrame) -> DataFrame:
    """key and payload of rows whose group has another text, and of the rows with numbers of words; of equal texts once."""
    order = Window.partitionBy("route").orderBy("key", "payload")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again = F.lag("key").over(order).eqNullSafe(F.col("key")) & F.lag("payload").over(order).eqNullSafe(F.col("payload"))
    seen = rows.withColumns({"_least": F.min("key").over(whole), "_most": F.max("key").over(whole), "_again": again})
    return seen.filter(f"not _again and (_least <> _most or first <> last or payload & 15 = {WORDS})").select("key", "payload")


def _witnessed(rows: DataFrame) -> DataFrame:
    """Rows whose group has another text: key, payload, route, whether it was spread, and the six witnesses, two to a column (0
    where there is none)."""
    hi, lo = (lambda c: F.shiftrightunsigned(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    seen = rows.withColumn("_hi", hi("key")).withColumn("_lo", lo("key"))
    order = Window.partitionBy("route").orderBy("_hi")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {f"_{n}_{k}": f(f"_{n}").over(whole) for n in ("hi", "lo") for k, f in (("least", F.min), ("most", F.max))}
    seen = seen.withColumns(ends | {"_before": F.lag("_hi").over(order), "_after": F.lead("_hi").over(order)})

    def pair(own, half, a, b):
        pick = lambda wide, near: F.when(F.col(wide) != F.col(own), F.col(wide)).when(half(near) != F.col(own), half(near)).otherwise(F.lit(0).cast("long"))
        return F.shiftleft(pick(a, "first"), 32).bitwiseOR(pick(b, "last"))

    packed = [pair("_hi", hi, "_hi_least", "_hi_most"), pair("_lo", lo, "_lo_least", "_lo_most"), pair("_hi", hi, "_before", "_after")]
    return seen.select("key", "payload", "route", "spread", *(x.alias(n) for x, n in zip(packed, WITNESSES, strict=True))).filter("ends <> 0 or others <> 0")


def _by_witness(t):
    """(document's number, payload, witness) of each row and witness of a table of whole documents, and the documents' keys."""
    key, payload = t.column("key").to_numpy(), t.column("payload").to_numpy()
    new = np.concatenate([[False], key[1:] != key[:-1]])
    doc, ids = np.cumsum(new), key[np.concatenate([[0], np.flatnonzero(new)])]
    out = []
    for name, tag in WITNESSES.items():
        both = t.column(name).to_numpy()
        least, most = (both >> 32) & _HALF, both & _HALF
        most = np.where(most == least, 0, most)
        for who in (least, most):
            at = np.flatnonzero(who)
            out.append((doc[at], payload[at], who[at] * 2 + tag))
    d, p, who = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((p, who, d))
    d, p, who = d[order], p[order], who[order]
    again = (d[1:] == d[:-1]) & (p[1:] == p[:-1]) & (who[1:] == who[:-1])  # rows equal in id and text
    one = np.concatenate([np.ones(min(1, len(d)), bool), ~again])
    return d[one], p[one], who[one], ids


def _merged(d, begin, end):
    """Intervals of the same d that overlap or touch made one; sorted."""
    if not len(d):
        return d, begin, end
    wide = int(end.max()) + 2
    x, y = d * wide + begin, d * wide + end
    order = np.argsort(x, kind="stable")
    x, y = x[order], np.maximum.accumulate(y[order])
    first = np.concatenate([[True], x[1:] > y[:-1]])
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(x) - 1]])
    of = x[first] // wide
    return of, x[first] - of * wide, y[last] - of * wide


def _list(offsets, values, kind):
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def _offsets(of, n):
    return np.searchsorted(of, np.arange(n + 1))


def _spans(d, begin, end, n):
    """The spans of n documents as lists; d is sorted."""
    pairs = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
    return _list(_offsets(d, n), pairs, None)


def _flat(column):
    """The row and the value of each item of a column of lists; of structs two values."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    items = column.flatten()
    values = items.flatten() if pa.types.is_struct(items.type) else [items]
    return np.repeat(np.arange(len(lengths)), lengths), *(v.to_numpy(zero_copy_only=False).astype(np.int64) for v in values)


def _candidates(batches):
    """Token intervals where windows of ENOUGH functions are shared, and the text's number of words. A document's windows of one
    function have disjoint starts, so the number of intervals over a start is the number of functions."""
    for t, _, _ in groups(batches, ["key"]):
        key, p = t.column("key").to_numpy(), t.column("payload").to_numpy()
        d = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        ids = key[np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])]
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        one = np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1])])  # equal texts have equal rows
        d, p = d[one], p[one]
        size = p & 15 == WORDS
        words = np.zeros(len(ids), np.int64)
        words[d[size]] = p[size] >> 4
        d, p = d[~size], p[~size]
        begin = p >> 32
        at = np.concatenate([begin, begin + ((p >> 4) & 0xFFFFFFF) + 1])
        step, doc = np.repeat(np.array([1, -1]), len(p)), np.tile(d, 2)
        order = np.lexsort((at, doc))
        at, doc = at[order], doc[order]
        count = np.cumsum(step[order])
        on = np.flatnonzero((count[:-1] >= ENOUGH) & (doc[1:] == doc[:-1]) & (at[1:] > at[:-1]))
        spans = _spans(*_merged(doc[on], at[on], at[on + 1] - 1 + TOKENS), len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), spans, pa.array(words)], ["key", "spans", "words"])


def _inside(batches):
    """Keys of a piece of texts, and document, value and position of each shingle in their candidates."""
    for b in batches:
        ids = b.column(0).to_numpy()
        spans = b.column(2).to_pylist()
        for begin, end, texts in text_pieces(b, 1, CHUNK):
            w = Batch([t.translate(LETTERS) for t in utf8(texts)], IS_LETTER)
            h, at = shingles(w, SHINGLE)
            doc = w.doc[at]
            first = np.searchsorted(doc, np.arange(end - begin + 1))
            inside = np.zeros(len(h) + 1, np.int32)
            for d, of in enumerate(spans[begin:end]):
                for s in of:
                    inside[min(first[d] + s["start"], first[d + 1])] += 1
                    inside[min(first[d] + s["end"], first[d + 1])] -= 1
            at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            d = doc[at]
            yield ids[begin:end], d, h[at], (at - first[d]).astype(np.int64)


def _tokens(batches):
    """The shingles of candidates, as rows of value and position."""
    for ids, d, h, at in _inside(batches):
        yield _rows(h, ids[d], at)


def _reach(group, at):
    """First and last index of the longest runs of one group's rows that lie in TOKENS positions, NEED rows at least. Rows are
    sorted by group and position."""
    if not len(at):
        return (np.zeros(0, np.int64),) * 2
    place = group * (int(at.max()) + TOKENS + 2) + at
    last = np.searchsorted(place, place + TOKENS) - 1
    first = np.flatnonzero(last - np.arange(len(last)) + 1 >= NEED)
    return first, last[first]


def _within(spans, d, begin, end):
    """Whether [begin, end) of document d lies in one of the merged spans."""
    of, x, y = spans
    if not len(of):
        return np.zeros(len(d), bool)
    at = np.searchsorted(of * _WIDE + x, d * _WIDE + begin, side="right") - 1
    return (at >= 0) & ((of * _WIDE + y)[at] >= d * _WIDE + end)


def _open(d, at, spans):
    """First and last index of the runs of shared shingles that the spans leave open."""
    first, last = _reach(d, at)
    left = ~_within(spans, d[first], at[first], at[last] + SHINGLE)
    return first[left], last[left]


def _ranges(first, last, n):
    """Which of n rows are in one of the ranges."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + 1, -1)
    return np.cumsum(step[:-1]) > 0


def _verified(batches):
    """The word spans that witnesses cover, and the shared shingles (position, value) of open runs."""
    for t, _, _ in groups(batches, ["key"]):
        d, at, who, ids = _by_witness(t)
        first, last = _reach(np.cumsum(np.concatenate([np.zeros(min(1, len(d)), bool), (d[1:] != d[:-1]) | (who[1:] != who[:-1])])), at)
        spans = _merged(d[first], at[first], at[last] + SHINGLE)
        key, at, route = (t.column(n).to_numpy() for n in ("key", "payload", "route"))
        spread = t.column("spread").to_numpy()
        d = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        order = np.lexsort((at, d))
        order = order[np.concatenate([[True], (d[order][1:] != d[order][:-1]) | (at[order][1:] != at[order][:-1])])]
        d, at, route, spread, key = (x[order] for x in (d, at, route, spread, key))
        mine = _ranges(*_open(d, at, spans), len(d))
        d, at = d[mine], at[mine]
        value = np.where(spread[mine], _spread(route[mine].view(_U), key[mine], at), route[mine].view(_U)).view(np.int64)
        rest = _offsets(d, len(ids))
        some = np.flatnonzero((rest[1:] > rest[:-1]) | (np.bincount(spans[0], minlength=len(ids)) > 0))
        lists = [_spans(*spans, len(ids)), _list(rest, at, pa.int32()), _list(rest, value, pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(ids), *lists], ["key", "spans", "at", "value"]).take(pa.array(some))


def _runs_of(b):
    """Of a batch of open shingles: row, position, value; the merged spans; the open runs."""
    (d, at), (_, value) = (_flat(b.column(n)) for n in ("at", "value"))
    spans = _merged(*_flat(b.column("spans")))
    return d, at, value.view(_U), spans, *_open(d, at, spans)


def _signatures(batches):
    """A value for the shared shingles of each open run."""
    for b in batches:
        d, at, value, _, first, last = _runs_of(b)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(value + _U(SHINGLE)), dtype=_U)])
        sign = mix(total[last + 1] - total[first] + _U(1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sign), pa.array(b.column("key").to_numpy()[d[first]]), pa.array(at[first], pa.int32()), pa.array(at[last] + SHINGLE, pa.int32())], ["sign", "key", "start", "end"])


def _stretches(batches):
    """Open stretches (overlapping open runs): their first position, the settled spans over them, their shingles."""
    for b in batches:
        d, at, value, (of, x, y), first, last = _runs_of(b)
        if not len(first):
            continue
        head = np.concatenate([[True], first[1:] > last[:-1]])
        begin, end = first[head], last[np.concatenate([head[1:], [True]])]
        mine = _ranges(first, last, len(d))
        offsets = _offsets((np.searchsorted(begin, np.arange(len(d)), side="right") - 1)[mine], len(begin))
        # spans are disjoint and sorted, by row and start as by row and end
        lo = np.searchsorted(of * _WIDE + y, d[begin] * _WIDE + at[begin], side="right")
        n = np.searchsorted(of * _WIDE + x, d[end] * _WIDE + at[end] + SHINGLE) - lo
        row = np.repeat(np.arange(len(begin)), n)
        k = np.repeat(lo, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        lists = [_spans(row, x[k], y[k], len(begin)), _list(offsets, at[mine], pa.int32()), _list(offsets, value[mine].view(np.int64), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(b.column("key").to_numpy()[d[begin]]), pa.array(at[begin], pa.int32()), *lists], ["key", "stretch", "spans", "at", "value"])


def _new(*columns):
    """Where a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _picked(batches):
    """Of each lane the text that most shingles of a stretch name."""
    for b in batches:
        names = b.column("picks").flatten().flatten().to_numpy().reshape(-1, LANES) ^ _LANES
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("picks")).to_numpy())
        own = b.column("key").to_numpy()
        row, lane, name = np.repeat(row, LANES), np.tile(np.arange(LANES), len(row)), names.ravel()
        order = np.lexsort((name, lane, row))
        order = order[name[order] != own[row[order]]]
        row, lane, name = row[order], lane[order], name[order]
        at = np.flatnonzero(_new(row, lane, name))
        count = np.diff(np.concatenate([at, [len(row)]]))
        row, lane, name = row[at], lane[at], name[at]
        most = np.lexsort((name, -count, lane, row))
        most = most[_new(row[most], lane[most])]
        most = most[np.lexsort((name[most], row[most]))]
        most = most[_new(row[most], name[most])]
        yield pa.RecordBatch.from_arrays([pa.array(own[row[most]]), b.column("stretch").take(pa.array(row[most])), pa.array(name[most])], ["key", "stretch", "other"])


def _total(chosen, s, a):
    """How many texts the chosen shingles of each run lead to at most; of an atom's, which are neighbours, one counts."""
    out = np.where(chosen, s, 0)
    before = np.maximum.accumulate(np.where(chosen, np.arange(chosen.shape[1]), -1), axis=1)[:, :-1]
    same = chosen[:, 1:] & (before >= 0) & (np.take_along_axis(a, np.maximum(before, 0), axis=1) == a[:, 1:])
    out[:, 1:][same] = 0
    return out.sum(axis=1)


def _probes(batches):
    """Of what is still open in a stretch, those values of which a text that adds a word has one: of an atom one value."""
    lanes = np.arange(TOKENS)
    for b in batches:
        (d, size), (_, atom) = (_flat(b.column(n)) for n in ("size", "atom"))
        _, at, value, spans, first, last = _runs_of(b)
        if not len(first):
            continue
        settled = _within(spans, d, at, at + SHINGLE)
        probe = np.zeros(len(d), bool)
        for i in range(0, len(first), 1 << 14):
            f, n = first[i : i + (1 << 14)], (last - first)[i : i + (1 << 14)] + 1
            rows = np.minimum(f[:, None] + lanes, len(d) - 1)
            inside = lanes < n[:, None]
            cost = np.where(inside, size[rows], np.iinfo(np.int64).max)
            rank = np.lexsort((atom[rows], cost), axis=1)
            s, a = np.take_along_axis(cost, rank, axis=1), np.take_along_axis(atom[rows], rank, axis=1)
            rare = np.broadcast_to(lanes, s.shape) < (n - NEED + 1)[:, None]
            done = settled[rows] & inside
            left, right = np.argmax(done, axis=1), TOKENS - 1 - np.argmax(done[:, ::-1], axis=1)
            at_ = at[rows]
            k = np.arange(len(f))
            gap = done.any(axis=1) & ~_within(spans, d[f], at_[k, left], at_[k, np.minimum(right, TOKENS - 1)] + SHINGLE)
            new = np.take_along_axis(inside & ~done, rank, axis=1)
            cheaper = ~gap & (_total(new, s, a) < _total(rare, s, a))
            probe[np.take_along_axis(rows, rank, axis=1)[np.where(cheaper[:, None], new, rare)]] = True
        seek = np.flatnonzero(probe)
        seek = seek[np.lexsort((value[seek], atom[seek], d[seek]))]
        seek = seek[_new(d[seek], atom[seek])]
        rows = np.unique(d[seek])
        offsets = np.concatenate([np.searchsorted(d[seek], rows), [len(seek)]])
        yield pa.RecordBatch.from_arrays([*(b.column(n).take(pa.array(rows)) for n in ("key", "stretch")), _list(offsets, value[seek].view(np.int64), pa.int64())], ["key", "stretch", "probe"])


def _bit(value):
    return value >> _U(64 - BITMAP_BITS - 6)


def _having(bits):
    """A text's values, sorted, that are in the bitmap of open ones."""

    def run(batches):
        for ids, d, h, _ in _inside(batches):
            at = _bit(h)
            on = np.flatnonzero(bits[at >> _U(6)] >> (at & _U(63)) & _U(1))
            order = on[np.lexsort((h[on], d[on]))]
            d, h = d[order], h[order]
            one = np.concatenate([np.ones(min(1, len(d)), bool), (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
            d, h = d[one], h[one]
            docs = np.unique(d)
            yield pa.RecordBatch.from_arrays([pa.array(ids[docs]), _list(np.concatenate([np.searchsorted(d, docs), [len(d)]]), h.view(np.int64), pa.int64())], ["other", "value"])

    return run


def _compared(batches):
    """Spans that the text `other` covers of open stretches; its own values (key is null) come before these."""
    have = np.zeros(0, _U)
    for b in batches:
        other, own = b.column("other").to_numpy(), pc.is_null(b.column("key")).to_numpy(zero_copy_only=False)
        (row, value), (_, at) = _flat(b.column("value")), _flat(b.column("at"))
        value, offsets = value.view(_U), _offsets(row, len(other))
        before = np.concatenate([[0], np.cumsum(np.where(own, 0, np.diff(offsets)))])  # own rows have no positions
        cut = np.concatenate([np.flatnonzero(own), [len(other)]])
        for begin, end in zip(np.concatenate([[-1], cut[:-1]]), cut, strict=True):
            if begin >= 0:
                have = value[offsets[begin] : offsets[begin + 1]]
            if begin + 1 == end or not len(have):
                continue
            v, r, a = value[offsets[begin + 1] : offsets[end]], row[offsets[begin + 1] : offsets[end]], at[before[begin + 1] : before[end]]
            hit = have[np.minimum(np.searchsorted(have, v), len(have) - 1)] == v
            r, a = r[hit], a[hit]
            first, last = _reach(r, a)
            r, x, y = _merged(r[first], a[first], a[last] + SHINGLE)
            if len(r):
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(pa.array(r)) for n in ("key", "stretch")), pa.array(x, pa.int32()), pa.array(y, pa.int32())], ["key", "stretch", "start", "end"])


def _union(batches):
    for b in batches:
        spans = _merged(*_flat(b.column("spans")))
        yield pa.RecordBatch.from_arrays([b.column("key"), _spans(*spans, b.num_rows)], ["key", "spans"])


def _as_list(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _with(rows: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """rows, the spans that others found added to theirs."""
    both = F.concat("spans", F.coalesce("_more", F.array().cast(LIST)))
    return rows.join(spans.withColumnRenamed("spans", "_more"), by, "left").withColumn("spans", both).drop("_more")


def _covered(pairs: DataFrame, stretches: DataFrame, having: DataFrame) -> DataFrame:
    """The spans of stretches that the texts paired with them cover. A text that many stretches meet is dealt over SALTS tasks."""
    salt = F.pmod(F.xxhash64("key", "stretch"), F.lit(SALTS))
    both = pairs.join(stretches.select("key", "stretch", "at", "value"), ["key", "stretch"]).select("other", salt.alias("salt"), "key", "stretch", "at", "value")
    none = [F.lit(None).cast("long").alias("key"), F.lit(None).cast("int").alias("stretch"), F.array().cast("array<int>").alias("at")]
    own = pairs.select("other", salt.alias("salt")).distinct().join(having, "other").select("other", "salt", *none, "value")
    # nulls are first in this order
    seen = own.unionByName(both).repartition("other", "salt").sortWithinPartitions("other", "salt", "key")
    return _as_list(seen.mapInArrow(lean(_compared), "key long, stretch int, start int, end int").distinct(), "key", "stretch")


def _rest(found: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """Tables of key and spans: what texts with the same open run, and all other partners, add to the spans found."""
    by = ["key", "stretch"]
    open_ = found.filter("size(at) > 0")
    signs = materialize(open_.mapInArrow(lean(_signatures), "sign long, key long, start int, end int"), "passage-signs")
    twice = signs.groupBy("sign").agg(F.min("key").alias("_a"), F.max("key").alias("_b")).filter("_a <> _b").select("sign")
    same = materialize(_as_list(signs.join(twice, "sign").select("key", "start", "end").distinct(), "key"), "passage-same")
    left = _with(open_.select("key", "spans", "at", "value"), same, ["key"])
    stretches = materialize(left.mapInArrow(lean(_stretches), f"key long, stretch int, spans {LIST}, at array<int>, value array<long>"), "passage-stretches")

    place = F.shiftrightunsigned(F.col("v"), 64 - BITMAP_BITS - 6)
    values = stretches.select(F.explode("value").alias("v"))
    words = values.select(place.alias("p")).selectExpr("shiftright(p, 6) as w", "shiftleft(1L, int(p & 63)) as bit")
    table = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    if not table.num_rows:
        return [same]
    bits = np.zeros(1 << BITMAP_BITS, _U)
    bits[table.column("w").to_numpy()] = table.column("bits").to_numpy().view(_U)
    having = materialize(texts.mapInArrow(lean(_having(bits)), "other long, value array<long>"), "passage-having")

    # equal rows of documents count alike for all their values, so sums stay the same for the same texts
    postings = having.select("other", F.explode("value").alias("v"))
    part = lambda k: F.sum(F.xxhash64("other", F.lit(k)).bitwiseAND(F.lit((1 << 36) - 1)))
    picks = F.array(*(F.min(F.col("other").bitwiseXOR(F.lit(int(x)))) for x in _LANES))
    stats = postings.join(values.distinct(), "v", "left_semi").groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.xxhash64(F.count(F.lit(1)), part(1), part(2)).alias("atom"), picks.alias("picks"))
    known = stretches.select(*by, F.explode(F.arrays_zip("at", "value")).alias("_x")).select(*by, F.col("_x.at").alias("at"), F.col("_x.value").alias("v"))
    known = known.join(stats.withColumn("picks", F.expr(f"if(size > {WIDE}, picks, null)")), "v")
    known = known.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "v", "size", "atom"))).alias("_x"), F.collect_list("picks").alias("picks"))
    known = materialize(known.select(*by, F.col("_x.at").alias("at"), F.col("_x.v").alias("value"), F.col("_x.size").alias("size"), F.col("_x.atom").alias("atom"), "picks"), "passage-known")

    wide = known.filter("size(picks) > 0").select(*by, "picks")
    picked = materialize(wide.mapInArrow(lean(_picked), "key long, stretch int, other long"), "passage-picked")
    some = materialize(_covered(picked, stretches, having), "passage-some")
    still = _with(known.drop("picks").join(stretches.select(*by, "spans"), by), some, by)
    sought = still.mapInArrow(lean(_probes), "key long, stretch int, probe array<long>").select(*by, F.explode("probe").alias("v"))
    pairs = materialize(sought.join(postings, "v").filter("key <> other").select(*by, "other").distinct(), "passage-pairs")
    return [same, some.select("key", "spans"), _covered(pairs, stretches, having).select("key", "spans")]


def passages(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """key, doc_id, spans (array of start, end in words): a row per document."""
    d = docs.select(row_key(doc_id, text).alias("key"), F.xxhash64(text).alias("t_key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    bounded_batches(d.sparkSession)
    windows = d.select("t_key", "text").mapInArrow(lean(_windows), ROWS)
    candidates = materialize(stream(_shared(windows), ["key"]).mapInArrow(lean(_candidates), f"{SPANS}, words long"), "passage-candidates")
    #: A row per text; the row that stands for it.
    texts = d.groupBy("t_key").agg(F.min("key").alias("c_row"), (F.min("key") != F.max("key")).alias("copied"))
    candidates = materialize(candidates.withColumnRenamed("key", "c_key").join(texts, F.col("c_key") == F.col("t_key")).drop("t_key"), "passage-texts")
    copied = candidates.filter("copied")
    c, _ = small(materialize(candidates.filter("size(spans) > 0").select("c_row", "c_key", "spans"), "passage-wanted"))
    wanted = d.join(c, F.col("key") == F.col("c_row")).select("c_key", "text", "spans")
    tokens = wanted.mapInArrow(lean(_tokens), ROWS)
    found = materialize(stream(_witnessed(tokens), ["key"]).mapInArrow(lean(_verified), f"{SPANS}, at array<int>, value array<long>"), "passage-witnessed")
    settled = copied.select(F.col("c_key").alias("key"))
    more = _rest(found.join(settled, "key", "left_anti"), wanted)
    whole = copied.select(F.col("c_key").alias("key"), F.expr("array(named_struct('start', 0, 'end', int(words)))").cast(LIST).alias("spans"))
    all_ = found.select("key", "spans")
    for m in [whole, *more]:
        all_ = all_.unionByName(m)
    merged = all_.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")).filter("size(spans) > 0")
    f, _ = small(materialize(merged.mapInArrow(lean(_union), SPANS), "passage-spans").withColumnRenamed("key", "f_key"))
    out = d.select("key", "t_key", "doc_id").join(f, F.col("t_key") == F.col("f_key"), "left")
    return out.select("key", "doc_id", F.coalesce("spans", F.array().cast(LIST)).alias("spans"))


def summary(found: DataFrame) -> DataFrame:
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), words.alias("n_repeated_words"), text.alias("spans"), (F.size("spans") > 0).alias("has_repeat"))
