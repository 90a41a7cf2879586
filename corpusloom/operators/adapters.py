"""Models over a column of texts: loaded once per task, fed in batches of segments, each text's outputs joined in order."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Many = Callable[[list[str]], list[str]]


def translated(rows: DataFrame, text: str, out: str, load: Callable[[], Many], split: Callable[[str], list[str]], batch: int = 16) -> DataFrame:
    """rows with `out`, the outputs of the text's segments with blanks between them; a null text has null, one without
    segments has an empty output. load() gives the model, a function from segments to as many outputs."""
    at = rows.columns.index(text)

    def run(batches):
        many = load()
        for b in batches:
            groups = [None if t is None else split(t) for t in b.column(at).to_pylist()]
            flat = [s for g in groups for s in g or ()]
            done: list[str] = []
            for i in range(0, len(flat), batch):
                part = many(flat[i : i + batch])
                if len(part) != len(flat[i : i + batch]):
                    raise ValueError("the model must give an output for each segment")
                done += part
            left = iter(done)
            joined = [None if g is None else " ".join(islice(left, len(g))) for g in groups]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(joined, pa.string())], [*b.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def features(rows: DataFrame, source: str, target: str, load: Callable[[], Callable[[str], list[int]]]) -> DataFrame:
    """rows with input_ids, attention_mask and labels, whole and in their order: the ids of source and target under the
    encoder that load() gives, once a task. A null text has null ids; nothing is computed before the rows are read."""
    at = [rows.columns.index(c) for c in (source, target)]
    ids = pa.list_(pa.int32())

    def run(batches):
        encode = load()
        for b in batches:
            x, y = ([None if t is None else encode(t) for t in b.column(i).to_pylist()] for i in at)
            mask = [None if v is None else [1] * len(v) for v in x]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, ids) for v in (x, mask, y))], [*b.schema.names, *FEATURES])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in FEATURES)]))


FEATURES = ("input_ids", "attention_mask", "labels")
