import json

import pytest

from corpusloom.operators import pairs as P
from corpusloom.sources import files


def test_examples_and_lexicon_and_aligned(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(x) for x in ({"id": 7, "en": "a", "vi": "b"}, {"row_id": "r", "en_clean": "c", "vi_clean": "d", "technical_tags": ["t"]})))
    got = sorted(tuple(r) for r in files.read_examples(spark, str(tmp_path / "x.jsonl")).collect())
    assert got == [("7", "a", "b", []), ("r", "c", "d", ["t"])]
    (tmp_path / "l.tsv").write_text("# c\n\nAPI\ta p i\n")
    assert [tuple(r) for r in files.read_lexicon(spark, str(tmp_path / "l.tsv"), ("term", "said")).collect()] == [("api", "a p i")]
    (tmp_path / "a").write_text("1\n2\n")
    (tmp_path / "b").write_text("x\ny\n")
    assert sorted(tuple(r) for r in files.read_aligned(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()) == [(0, "1", "x"), (1, "2", "y")]


def test_release_is_written_once(spark, tmp_path):
    rows = [("s", i, f"Text {i}", f"Ban {i}", None) for i in range(10)]
    out = P.release(spark.createDataFrame(rows, "source_short_name string, raw_row_index long, en string, vi string, category string"))
    files.write_release(out, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/parquet")).count() == 10
    with pytest.raises(FileExistsError):
        files.write_release(out, str(tmp_path / "r"))
    assert files.manifest(spark, str(tmp_path / "r")).filter("length(sha256) = 64").count() > 0


def test_sheets(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('\ufeffjunk line\nrow_id\tlabel\nr1\tyes\nr2\t"maybe\nnot"\nr2\tno\n\tno\nr9\tno\n')
    sheet = files.read_sheet(spark, f"{tmp_path}/s.tsv", ("row_id", "label"), "\t", skip=1)
    assert sheet.count() == 5
    ids = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "row_id string")
    got = sorted(tuple(r) for r in files.sheet_problems(sheet, ids, "row_id", ("label",)).collect())
    assert got == [("", "blank_id"), ("", "not_asked"), ("r2", "label_not_allowed"), ("r2", "repeated"), ("r3", "missing"), ("r9", "not_asked")]
    with pytest.raises(ValueError):
        files.read_sheet(spark, f"{tmp_path}/s.tsv", ("row_id", "other"), "\t", skip=1)


def test_documents_and_cases(spark, tmp_path):
    for name, text in (("a.json", '{"id": "a", "messages": [{"turn": 1}]}'), ("b.json", '{"id": "b", '), ("c.json", "{}"), ("d.txt", '{"id": "d"}')):
        (tmp_path / name).write_text(text)
    got = files.read_documents(spark, str(tmp_path), "id string, messages array<struct<turn:int>>").collect()
    assert [(r.id, r.messages[0].turn) for r in got] == [("a", 1)]
    (tmp_path / "cases").write_text(json.dumps({"cases": [{"id": "x", "input": "API"}, {"id": "y", "input": "ok"}]}, indent=1))
    assert [tuple(r) for r in files.read_cases(spark, f"{tmp_path}/cases", "id:string,input:string").collect()] == [(0, "x", "API"), (1, "y", "ok")]
