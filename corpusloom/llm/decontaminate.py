"""Operator 8: benchmark decontamination with an FM-index per shard of documents.

A shard is a run of documents of a task. Its words become symbols: words of the benchmark get a number of their own, all
others are one separator, as no phrase can span them; stretches shorter than the shortest phrase hold no occurrence and are
left out. Over the symbols stands an FM-index: a full suffix array by prefix doubling, its BWT in a wavelet matrix with rank
counts, and sampled suffix positions. All phrases of a length are searched backwards at once; occurrences are located by
walking to a sampled position, and overlapping ones merge into removal spans.

Phrases: every window of WINDOW consecutive words of an item; an item of fewer words, but not none, is one phrase. The
benchmark is read in blocks of at most BLOCK_WORDS words; each block is searched in all documents and the blocks' spans are
merged, so its size is not bounded by one broadcast.

Defined results: null and empty texts have no words and no hits; items without words are never found; items with equal ids
count once; a null item id is the empty string; equal rows give equal results; an empty table, on either side, gives no
hits; other columns are ignored by find() and handed through by decontaminated(). A text of any length is a shard of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_LETTER, LETTERS, Batch, bounded_batches, fresh, lean, materialize, recount, rewritten, row_key, text_pieces, utf8

WINDOW = 10
BLOCK_WORDS = 500_000
SHARD_BYTES = 1 << 18
SAMPLE = 8
TERMINATOR, SEPARATOR, FIRST_WORD = 0, 1, 2


class WaveletMatrix:
    """Bits of the symbols from the highest down, each level stably split by the bit before, with counts for ranks."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.size = len(symbols)
        s = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (s >> level) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(s) - int(ones[-1])
            self.levels.append((level, ones, zeros))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        begin, i = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level, ones, zeros in self.levels:
            bit = ((symbol >> level) & 1).astype(bool)
            begin = np.where(bit, zeros + ones[begin], begin - ones[begin])
            i = np.where(bit, zeros + ones[i], i - ones[i])
        return i - begin

    def access(self, i: np.ndarray) -> np.ndarray:
        i, out = i.astype(np.int64), np.zeros(len(i), np.int64)
        for level, ones, zeros in self.levels:
            bit = ones[i + 1] - ones[i]
            out |= bit.astype(np.int64) << level
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of s, whose last symbol is the only TERMINATOR; ranks double their reach until all differ."""
    n, rank, reach = len(s), s.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    new = np.empty(n, np.int64)
    new[order] = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(rank[order]) != 0)])
    rank = new
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: max(0, n - reach)] = rank[reach:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(key[order]) != 0)])
        rank, reach = new, reach * 2
    return order


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        s = np.concatenate([symbols, np.array([TERMINATOR])]).astype(np.int64)
        sa = suffix_array(s)
        self.tree = WaveletMatrix(s[sa - 1], n_symbols)
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(s, minlength=n_symbols))])
        marked = sa % SAMPLE == 0
        self.mark = np.concatenate([np.zeros(1, np.int64), np.cumsum(marked)])
        self.marked, self.sampled = marked, sa[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [begin, end) of the suffixes that start with each phrase; phrases: one per row, of one length."""
        begin = self.before[phrases[:, -1]].copy()
        end = self.before[phrases[:, -1] + 1].copy()
        for k in range(phrases.shape[1] - 2, -1, -1):
            live = np.flatnonzero(begin < end)
            if not len(live):
                break
            c = phrases[live, k].astype(np.int64)
            begin[live], end[live] = self.before[c] + self.tree.rank(c, begin[live]), self.before[c] + self.tree.rank(c, end[live])
        return begin, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(rows):
            done = self.marked[rows]
            out[at[done]] = self.sampled[self.mark[rows[done]]] + steps
            rows, at = rows[~done], at[~done]
            c = self.tree.access(rows)
            rows, steps = self.before[c] + self.tree.rank(c, rows), steps + 1
        return out


class Phrases:
    """The phrases of a block of items, as symbols of the block's vocabulary; all in arrays, some 60 bytes a phrase."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(self.ids)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + FIRST_WORD) for w in text.translate(LETTERS).split()], np.int32)
            if len(words):
                n = min(window, len(words))
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(words, n), number[item]))
        self.by_length = [self._distinct(x) for _, x in sorted(found.items())]
        self.shortest = min(found, default=0)
        self.size = len(self.vocabulary) + FIRST_WORD
        words = list(self.vocabulary)
        hashes = Batch(words, IS_LETTER).hash if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.symbols = hashes[order], np.fromiter(self.vocabulary.values(), np.int64, len(words))[order]
        del self.vocabulary

    @staticmethod
    def _distinct(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct phrases as rows, where each one's owners begin, the owners' numbers)."""
        rows, which = np.unique(np.concatenate([w for w, _ in parts]), axis=0, return_inverse=True)
        owner = np.repeat([n for _, n in parts], [len(w) for w, _ in parts])
        pairs = np.unique(np.stack([which.ravel(), owner], 1), axis=0)
        return rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1].astype(np.int32)


def search_shard(texts: list[bytes], phrases: Phrases):
    """(words per text, and for each text with a hit: merged spans of hit words, numbers of the items found)."""
    b = Batch(texts, IS_LETTER)
    none = b.n_words, {}
    if not phrases.shortest or not len(b.hash):
        return none
    at = np.searchsorted(phrases.hashes, b.hash)
    at[at == len(phrases.hashes)] = 0
    known = np.where(phrases.hashes[at] == b.hash, phrases.symbols[at], SEPARATOR)
    run = np.cumsum((known == SEPARATOR) | (np.diff(b.doc, prepend=-1) != 0))
    run[known == SEPARATOR] = 0
    keep = (np.bincount(run, minlength=1) >= phrases.shortest)[run] & (known != SEPARATOR)
    word = np.flatnonzero(keep)
    if not len(word):
        return none
    gap = np.diff(run[word], prepend=-1) != 0
    place = np.cumsum(gap) + np.arange(len(word))  # one separator stands before each stretch
    symbols = np.full(place[-1] + 1, SEPARATOR, np.int64)
    symbols[place] = known[word]
    word_at = np.zeros(len(symbols), np.int64)
    word_at[place] = word
    index = FMIndex(symbols, phrases.size)
    cover = np.zeros(len(b.hash) + 1, np.int64)
    items: dict[int, set[int]] = {}
    for ps, owned, owners in phrases.by_length:
        begin, end = index.search(ps)
        count = np.maximum(end - begin, 0)
        which = np.repeat(np.arange(len(ps)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + begin[which]
        first = word_at[index.locate(rows)] if len(rows) else rows
        np.add.at(cover, first, 1)
        np.subtract.at(cover, first + ps.shape[1], 1)
        for d, p in set(zip(b.doc[first].tolist(), which.tolist(), strict=True)):
            items.setdefault(d, set()).update(owners[owned[p] : owned[p + 1]].tolist())
    hit = np.cumsum(cover[:-1]) > 0
    found = {}
    for d, who in items.items():
        flags = hit[b.first[d] : b.first[d + 1]]
        edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
        found[d] = (np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1), who)
    return b.n_words, found


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _search(phrases: Phrases):
    def run(batches):
        for b in batches:
            for begin, end, texts in text_pieces(b, 2, SHARD_BYTES):
                n_words, found = search_shard([t.translate(LETTERS) for t in utf8(texts)], phrases)
                s = b.slice(begin, end - begin)
                spans = [[{"start": int(x), "end": int(y)} for x, y in found[i][0]] if i in found else [] for i in range(end - begin)]
                items = [[phrases.ids[k] for k in sorted(found[i][1])] if i in found else [] for i in range(end - begin)]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), s.column(1), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["key", "doc_id", "n_words", "spans", "items"]
                )

    return lean(run)


def distinct_items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).filter("text is not null").distinct()


def n_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> int:
    total = distinct_items(benchmark, item_id, text).agg(F.sum(F.length("text"))).first()[0] or 0
    return 1 if total <= 4 * block_words else -(-total // (2 * block_words))


def blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int):
    """The items in blocks of bounded size: numbered by running length, each block collected alone."""
    from pyspark.sql import Window

    items, n = distinct_items(benchmark, item_id, text), n_blocks(benchmark, item_id, text, block_words)
    if n == 1:
        rows = items.collect()
        yield [(r.item, t) for r, t in zip(rows, utf8([r.text for r in rows]), strict=True)]
        return
    dealt = materialize(items.withColumn("_block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "benchmark-blocks")
    for k in range(n):
        rows = dealt.filter(F.col("_block") == k).collect()
        yield [(r.item, t) for r, t in zip(rows, utf8([r.text for r in rows]), strict=True)]


def find(docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window=WINDOW, block_words=BLOCK_WORDS) -> DataFrame:
    """key, doc_id, n_words, spans (array of start, end in words, merged), items (ids found, sorted): a row per document."""
    d = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"key long, doc_id {kind}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    bounded_batches(d.sparkSession)
    parts = [d.mapInArrow(_search(Phrases(items, window)), schema) for items in blocks(benchmark, item_id, item_text, block_words)]
    if len(parts) == 1:
        return parts[0]
    # every block has a row for each document; only the hits of the later ones are joined to the first's rows
    kept = [materialize(p, "decontaminate-block") for p in parts]
    hits = kept[0].filter("size(spans) > 0")
    for p in kept[1:]:
        hits = hits.unionByName(p.filter("size(spans) > 0"))
    merged = hits.groupBy("key", "doc_id").agg(F.flatten(F.collect_set("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    merged = merged.withColumnsRenamed({"key": "m_key", "doc_id": "m_id"})
    out = kept[0].join(merged, (F.col("key") == F.col("m_key")) & F.col("doc_id").eqNullSafe(F.col("m_id")), "left")
    return out.select("key", "doc_id", "n_words", F.coalesce(merge_spans(F.col("s")), F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("i", F.array().cast("array<string>")).alias("items"))


def merge_spans(spans):
    """Sorted spans with those that overlap or touch made one."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, add)


def summary(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cut(text: str, spans) -> str:
    """text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    b = Batch([raw], IS_LETTER)
    out, at = [], 0
    for begin, end in spans:
        out.append(raw[at : b.start[begin]])
        at = int(b.end[end - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _clean(phrases: Phrases):
    def change(texts, *_):
        for d, (spans, _) in search_shard([t.translate(LETTERS) for t in utf8(texts)], phrases)[1].items():
            texts[d] = cut(texts[d], spans.tolist())
        return texts

    def run(batches):
        for b in batches:
            yield from rewritten(b, "text", SHARD_BYTES, change)

    return lean(run)


def _cut(batches):
    for b in batches:
        spans, rest = b.column(b.num_columns - 1), pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1])
        change = lambda texts, x, y, of=spans: [cut(t, [(p["start"], p["end"]) for p in s]) if s else t for t, s in zip(texts, of.slice(x, y - x).to_pylist(), strict=True)]
        yield from rewritten(rest, "text", SHARD_BYTES, change)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window=WINDOW, block_words=BLOCK_WORDS) -> DataFrame:
    """docs with all removal spans cut out, with the columns of docs (n_chars counts the new text).

    Spans of all blocks are found in the original text and cut at once, so the number of blocks doesn't change the result."""
    bounded_batches(docs.sparkSession)
    if n_blocks(benchmark, "item_id", "text", block_words) == 1:
        (items,) = blocks(benchmark, "item_id", "text", block_words)
        return recount(docs.mapInArrow(_clean(Phrases(items, window)), docs.schema), docs)
    row, key, id_, spans = fresh(docs, "row_key", "found_key", "found_id", "found_spans")
    found = find(docs, benchmark, window=window, block_words=block_words).filter("size(spans) > 0")
    found = found.select(F.col("key").alias(key), F.col("doc_id").alias(id_), F.col("spans").alias(spans)).dropDuplicates([key, id_])
    found = materialize(found, "decontaminate-spans")
    d = docs.withColumn(row, row_key()).join(found, (F.col(row) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    return recount(d.select(*(F.col(f"`{c}`") for c in docs.columns), spans).mapInArrow(lean(_cut), docs.schema), docs)
