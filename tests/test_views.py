import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import adapters
from corpusloom.sources import files
from corpusloom.streaming import view

EFFECT = "conv_id long, seq long, turn long, effect string, party string, text string, typed boolean, notes array<string>"
ROWS = [
    (1, 1, 1, "add_message", "A", "one", False, ["x"]),
    (1, 1, 1, "translate", None, None, None, None),
    (1, 2, 1, "set_translation:failed", None, None, None, ["x", "y"]),
    (1, 3, 1, "mark_interrupted", None, None, None, None),
    (1, 4, 1, "replace_source", "B", "two", True, None),
    (1, 4, 1, "set_translation:ok", None, "zwei", None, ["z"]),
    (1, 5, 2, "replace_source", "A", "never added", True, None),
    (1, 6, None, "notice:busy", None, None, None, None),
    (2, 1, 1, "add_message", "A", "hello", False, None),
    (2, 2, 1, "mark_interrupted", None, None, None, None),
]
LEFT = {(1, 1, "B", "two", "zwei", "ok", True, True, False, "z"), (2, 1, "A", "hello", None, "translating", False, False, True, "")}


def shown(df):
    return {tuple(r) for r in df.withColumn("notes", F.array_join("notes", ",")).collect()}


def test_view_follows_the_effects_whatever_their_order(spark):
    assert shown(view.messages(spark.createDataFrame(ROWS[::-1], EFFECT).repartition(3))) == LEFT
    assert not shown(view.messages(spark.createDataFrame([], EFFECT)))


def test_view_of_a_stream_ends_as_the_table(spark, tmp_path):
    for i in range(0, len(ROWS), 4):
        spark.createDataFrame(ROWS[i : i + 4], EFFECT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = view.bounded_stream(spark, str(tmp_path / "in"), EFFECT, files=1)
    q = view.messages(stream).writeStream.format("memory").queryName("shown").outputMode("complete").start()
    q.processAllAvailable()
    batches = [p for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    assert len(batches) == 3 and shown(spark.table("shown")) == LEFT


def test_bounded_queue_against_a_loop(spark):
    rng, rows, want = random.Random(5), [], set()
    for q in "ab":
        ready = free = 0
        started = []
        for i in range(300):
            ready, took = ready + rng.randrange(6), rng.randrange(11)
            accepted = ready if len(started) < 8 else max(ready, started[-8])
            started.append(max(accepted, free))
            free = started[-1] + took
            rows.append((q, i, ready, took))
            want.add((q, i, accepted, started[-1], free))
    x = spark.createDataFrame(rows, "q string, i long, ready long, took long").repartition(4)
    got = view.admitted(x, "q", "i", "ready", "took", 8).select("q", "i", "accepted_at", "started_at", "ended_at")
    assert {tuple(r) for r in got.collect()} == want


def test_features_are_whole_and_keep_nulls(spark):
    x = spark.createDataFrame([(1, "ab c", None), (2, "", "d")], "id long, s string, t string")
    got = adapters.features(x, "s", "t", lambda: lambda t: list(t.encode())).collect()
    assert [(r.id, r.input_ids, r.attention_mask, r.labels) for r in got] == [(1, [97, 98, 32, 99], [1] * 4, None), (2, [], [], [100])]


def test_ranges_and_escapes(spark):
    x = spark.createDataFrame([([3, 1, 2, 2, 0x1F600, 14],), ([],)], "p array<int>")
    assert [r[0] for r in x.select(T.code_point_ranges(F.col("p"))).collect()] == ["U+0001-U+0003 U+000E U+1F600", ""]
    texts = ["plain", "é ​ �\x7f", "\U000e0001 é あ", "\U0001f600", None]
    rows = spark.createDataFrame([(i, None if t is None else json.dumps(t, ensure_ascii=False)) for i, t in enumerate(texts)], "i int, j string")
    got = [r[0] for r in rows.orderBy("i").select(T.invisible_escaped("j")).collect()]
    assert got[1] == '"e\\u0301 \\u200b\\u2028\\ufffd\\u007f"' and got[2] == '"\\udb40\\udc01 é あ"' and got[3] == '"\U0001f600"'
    assert [None if j is None else json.loads(j) for j in got] == texts


def test_tree_hash_orders_by_path_parts(spark, tmp_path):
    root = tmp_path / "t t"
    for name, content in (("a/b", b"1"), ("a-b", b"\0" * 3_000_000), ("a/c d%20", b""), ("z", b"\xff")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    digest = hashlib.sha256()
    for name in ("a/b", "a/c d%20", "a-b", "z"):
        digest.update(name.encode() + b"\0" + (root / name).read_bytes() + b"\0")
    assert files.tree_hash(spark, str(root)) == digest.hexdigest()
    with pytest.raises(FileNotFoundError):
        files.tree_hash(spark, str(root / "z"))
