import pytest
from pyspark.sql import functions as F

from corpusloom.operators import gates as G
from corpusloom.sources import files, reports
from corpusloom.streaming import timers


def test_csv_json_and_ranked(spark, tmp_path):
    x = spark.createDataFrame([("a|b", 2), ("c", 3), (None, 2)], "term string, n int").orderBy("n", "term")
    reports.write_csv(x, f"{tmp_path}/r.csv")
    assert (tmp_path / "r.csv").read_bytes() == b"\xef\xbb\xbfterm,n\r\n,2\r\na|b,2\r\nc,3\r\n"
    with pytest.raises(Exception, match="exist"):
        reports.write_csv(x, f"{tmp_path}/r.csv")
    with pytest.raises(ValueError):
        reports.bounded(x, 2)
    reports.write_ranked(x.filter("term is not null"), f"{tmp_path}/t.tsv", "here", "n", "term", 1)
    assert (tmp_path / "t.tsv").read_text().splitlines()[-1] == "c\t3"
    assert "| a\\|b | 2 |" in reports.card("X", {"Terms": x})


def test_review_sheet(spark, tmp_path):
    rows = [(str(i), "e", "v", ["has_path"] if i == 7 else ["has_ui"] if i % 2 else []) for i in range(10)]
    x = spark.createDataFrame(rows, "row_id string, en string, vi string, technical_tags array<string>")
    reports.write_review(x, 3, "s", f"{tmp_path}/review")
    assert (tmp_path / "review/sheet.csv").read_text().splitlines()[1].startswith("7,e,v,has_path,,,")
    with pytest.raises(ValueError):
        reports.review_rows(x, 6, "s")


def test_write_or_verify_and_if_changed(spark, tmp_path):
    p, stamp = f"{tmp_path}/f.json", r'"at": "[^"]*"'
    assert files.write_or_verify(spark, p, '{"at": "1", "x": "é"}') and not files.write_or_verify(spark, p, '{"at": "2", "x": "é"}', stamp)
    with pytest.raises(ValueError):
        files.write_or_verify(spark, p, "other", stamp)
    assert not files.write_if_changed(spark, p, '{"at": "3", "x": "é"}', stamp) and files.write_if_changed(spark, p, '{"at": "3", "x": "y"}', stamp)
    assert files.read_text(spark, p) == '{"at": "3", "x": "y"}'


def test_log_keeps_the_newest(spark, tmp_path):
    batches = [spark.range(a, b).select(F.col("id"), F.col("id").alias("t")) for a, b in ((0, 8), (6, 11), (11, 16))]
    for b in batches:
        timers.append_log(b, f"{tmp_path}/log", "t", "id", most=10, slack=2)
    assert sorted(r.id for r in timers.read_log(spark, f"{tmp_path}/log").collect()) == list(range(6, 16))


def test_stream_of_changes_is_debounced(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:00.{i}00", i) for i in (1, 2, 3, 8)] + [(2, "2024-01-01 00:00:00.500", 9), (3, "2024-01-01 01:00:00", 0)]
    x = spark.createDataFrame(rows, "k int, t string, v int").withColumn("t", F.col("t").cast("timestamp"))
    x.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(x.schema).parquet(f"{tmp_path}/in")
    q = timers.stream_debounced(stream, "k", "t", "1 second").writeStream.format("memory").queryName("saved").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.k, r.saved.v) for r in spark.table("saved").collect())
    batch = sorted((r.k, r.v) for r in timers.debounced(x, "k", "t", "v").collect() if r.k != 3)
    assert got == batch == [(1, 3), (1, 8), (2, 9)]


def test_gates_on_nothing_and_nulls(spark):
    none = spark.createDataFrame([], "path string, bytes long, sha256 string")
    one = spark.createDataFrame([("a", None, "x")], none.schema)
    assert G.manifest_problems(none, none).count() == 0 and G.manifest_problems(one, one).count() == 0
    assert [r.problem for r in G.manifest_problems(one, none).collect()] == ["missing"]
    got = spark.range(1).select(G.problems({"a": F.lit(None).cast("boolean"), "b": F.lit(True)}).alias("p"), G.verdict(F.lit(None).cast("int"), F.lit(1)).alias("v")).first()
    assert got.p == ["a"] and got.v == "WAITING"
