from corpusloom.streaming import conversation, endpointing


def run(*events):
    m, out = conversation.Machine(), []
    for e in events:
        out.append(m.handle(e))
    return m, out


def test_turn_is_spoken_and_cut():
    m, out = run({"kind": "tap", "party": "A"}, {"kind": "tap", "party": "A"}, {"kind": "listen_ended", "turn": 1, "result": "text"}, {"kind": "translated", "turn": 1, "result": "ok"}, {"kind": "tap", "party": "B"})
    assert out == [
        [("start_listen", 1)], [("stop_listen", 1)], [("add_message", 1), ("translate", 1)], [("set_translation:ok", 1), ("speak", 1)],
        [("stop_speak", None), ("mark_interrupted", 1), ("start_listen", 2)],
    ]
    assert m.phase == "listening" and m.party == "B"


def test_stale_events_do_nothing_and_reset_keeps_ids():
    m, out = run({"kind": "tap", "party": "A"}, {"kind": "reset", "turn": 0}, {"kind": "listen_ended", "turn": 1, "result": "text"}, {"kind": "tap", "party": "A"})
    assert out == [[("start_listen", 1)], [("stop_listen", 1)], [], [("start_listen", 2)]]


def test_typed_text_is_never_spoken():
    m, out = run({"kind": "typed", "party": "A", "text": " hi "}, {"kind": "translated", "turn": 1, "result": "ok"})
    assert out == [[("add_message", 1), ("translate", 1)], [("set_translation:ok", 1)]] and m.phase == "idle"


def test_endpoint_batch_and_stream_agree(spark, tmp_path):
    rows = []
    for s, spoken in (("a", range(31, 62)), ("b", ()), ("c", range(1, 3000))):
        rows += [(s, i, i * 32, (i - 1) * 32, i in spoken) for i in range(1, 2000)]
    df = spark.createDataFrame(rows, "session_id string, seq long, elapsed_ms long, begin_ms long, is_speech boolean")
    batch = {tuple(r) for r in endpointing.ends(df).collect()}
    assert batch == {("a", "END_SILENCE", 61 * 32 + 1504), ("b", "NO_SPEECH", 6016), ("c", "MAX_TURN", 60000)}
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = endpointing.stream_ends(stream).writeStream.format("memory").queryName("ends").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("ends").collect()} == batch
    runs = endpointing.segments(df.filter("session_id = 'a'")).collect()
    assert [(r.start_ms, r.end_ms, r.from_ms, r.to_ms) for r in runs] == [(960, 61 * 32, 560, 61 * 32 + 200)]
