"""Shared helpers: scratch tables in the cluster's shared folder, size-checked joins, vectorised word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only when it was written, its rows and bytes summed, and both found no larger than this.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 24 << 20
_U = np.uint64


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset, a temporary folder if all runs in this process
    (tests); on a cluster that is an error, as executors would write to disks of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        out = F.lit(8)
        for f in kind.fields:
            out = out + bytes_of(column[f.name], f.dataType)
        return out
    if isinstance(kind, T.ArrayType):
        add = lambda total, x: total + bytes_of(x, kind.elementType).cast("long")
        return F.coalesce(F.aggregate(column, F.lit(24).cast("long"), add), F.lit(0))
    return F.lit(8)


def small(df: DataFrame) -> tuple[DataFrame, bool]:
    """A materialised table, with a broadcast hint if its rows and their summed bytes are under the bounds, and whether they are."""
    size = F.lit(16)
    for f in df.schema.fields:
        size = size + bytes_of(F.col(f"`{f.name}`"), f.dataType)
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    fits = rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES
    return (F.broadcast(df) if fits else df), fits


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """A 64-bit key of a row's id and text; joins use it together with the id. Equal rows have equal keys."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where df has a column so called (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def recount(out: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars, where docs has such a number, counts the new text."""
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return out.withColumn("n_chars", F.length("text").cast(kind)) if isinstance(kind, T.NumericType) else out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_PRIME = (1 << 31) - 1
_M = _U(_PRIME)
_SLICE_BITS = 13
_SLICE = 1 << _SLICE_BITS
_STEP = _U(0x9E3779B97F4A7C15)


def _fold(x: np.ndarray) -> np.ndarray:
    return (x & _M) + (x >> _U(31))


def _mod(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    return np.where(x >= _M, x - _M, x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, _mod(out * _U(pow(base, len(out), _PRIME)))])
    return out[:n]


class Base:
    """Polynomial hashes modulo 2^31 - 1 with one base. A prime modulus, unlike a power of two, keeps a random base's hashes
    of any two different texts apart (but for about length / 2^31); two bases together make collisions as rare as its square."""

    def __init__(self, base: int):
        self.base = base
        self.up, self.down = _powers(base, _SLICE), _powers(pow(base, -1, _PRIME), _SLICE)
        self.high = _powers(pow(base, _SLICE, _PRIME), 1 << (31 - _SLICE_BITS))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """The hash of each prefix, in slices, so that the 64-bit products are never there for a whole text."""
        out, last = np.zeros(len(values) + 1, np.uint32), 0
        for i in range(0, len(values), _SLICE):
            v = values[i : i + _SLICE].astype(_U)
            v += _U(1)
            v *= self.down[: len(v)]
            c = _fold(np.cumsum(v))
            c += _U(last * self.base % _PRIME)
            c *= self.up[: len(c)]
            out[i + 1 : i + 1 + len(c)] = c = _fold(_fold(c))  # not always below the prime, but spans() sees to that
            last = int(c[-1])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        power = _mod(self.up[n & (_SLICE - 1)] * self.high[n >> _SLICE_BITS])
        return _mod(prefix[ends].astype(_U) + _M - _mod(prefix[starts].astype(_U) * power))


#: Two bases drawn once at random.
_BASES = (Base(1_284_716_903), Base(903_441_617))


def prefix_hash(values: np.ndarray) -> list[np.ndarray]:
    """Hashes of all prefixes of an array of bytes; with span_hash they give the hash of any span in constant time."""
    return [b.prefix(values) for b in _BASES]


def span_hash(prefix: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 62-bit hash of each span [start, end), mixed to 64: the same bytes give the same hash wherever they stand."""
    a, b = (base.spans(p, starts, ends) for base, p in zip(_BASES, prefix, strict=True))
    return mix((a << _U(31) | b) + mix((ends - starts).astype(_U)))


#: Lower-cases A-Z, keeps digits, letters and every byte of non-ASCII characters, makes the rest blank.
LETTERS = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32) if c < 128 else c for c in range(256))
IS_LETTER = np.array([b != 32 for b in LETTERS])
IS_SPACE = np.array([c in (9, 10, 11, 12, 13, 32) for c in range(256)])


class Batch:
    """The words of some texts as arrays. doc: the text's index for each word; start, end: bytes in buf; hash: 64 bits."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offset = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        self.buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = is_word[self.buf]
        edge = np.diff(inside)
        del inside
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        del edge
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        self.prefix = prefix_hash(self.buf)
        self.hash = span_hash(self.prefix, self.start, self.end)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # of each text's words
        self.n_words = np.diff(self.first)

    def total(self, flags: np.ndarray) -> np.ndarray:
        """The flagged bytes of each text."""
        return np.add.reduceat(flags, self.offset[:-1], dtype=np.int64) if len(self.n_words) else np.zeros(0, np.int64)


def _join(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = h * _STEP
    h ^= h >> _U(29)
    return h + word


def shingles(batch: Batch, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of each window of n words that lies in one text."""
    m = len(batch.hash) - n + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = batch.hash[:m]
    for i in range(1, n):
        h = _join(h, batch.hash[i : m + i])
    at = np.flatnonzero(batch.doc[:m] == batch.doc[n - 1 :])
    return mix(h[at]), at


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """One value, in an array of its own, for a short sequence of word hashes."""
    h = words[:1]
    for i in range(1, len(words)):
        h = _join(h, words[i : i + 1])
    return mix(h + _U(len(words)))


def chunks(sizes: list[int], most: int):
    """Slices of consecutive items whose sizes add up to at most `most`; an item larger than that stands alone."""
    begin = total = 0
    for i, s in enumerate(sizes):
        if i > begin and total + s > most:
            yield begin, i
            begin, total = i, 0
        total += s
    if sizes:
        yield begin, len(sizes)


def utf8(texts) -> list[bytes]:
    """Whole texts as UTF-8, null as empty."""
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


#: Arrow batches are cut at this many bytes where the session can do that, so that long texts don't add up in a worker.
BATCH_BYTES = 4 << 20
#: Rows that the Parquet reader decodes at once; it has no limit of bytes, and Spark's 4096 whole texts may be gigabytes.
READ_ROWS = 256


def bounded_batches(spark: SparkSession) -> None:
    """Set the byte limit of Arrow batches and the rows of a read, unless the session has lower ones."""
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(rows)) > READ_ROWS:
        spark.conf.set(rows, str(READ_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", str(spark.conf.get(name)).strip().lower())
    if not now or int(now[1]) <= 0 or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def text_pieces(batch, column: int, most: int):
    """(begin, end, texts as str or None) of consecutive rows with at most `most` bytes of text; only these become objects."""
    c = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(c), 0).to_pylist()
    for begin, end in chunks(sizes, most):
        yield begin, end, c.slice(begin, end - begin).to_pylist()


def rewritten(batch, column: str, most: int, change):
    """The batch in pieces of at most `most` bytes of text, the texts of each put through change(texts, begin, end)."""
    names = batch.schema.names
    at = names.index(column)
    for begin, end, texts in text_pieces(batch, at, most):
        cols = batch.slice(begin, end - begin).columns
        cols[at] = pa.array(change(texts, begin, end), batch.schema.types[at])
        yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)


def lean(run):
    """run, a function over Arrow batches, but its worker gives the memory that it no longer uses back when a task ends:
    workers are kept for later tasks, and what one stage left to them would add up with the next one's."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return wrapped
