import json

import pytest

from corpusloom.operators import adapters
from corpusloom.sources import files


def test_evidence_is_joined_by_path(spark, tmp_path):
    for exp, ckpt, role, run in (("e1", "c1", "v", True), ("e1", "c1", "g", False), ("e2", "c1", "v", True)):
        at = tmp_path / "m" / exp / ckpt / role
        at.mkdir(parents=True)
        (at / "metrics.json").write_text(json.dumps({"rows": 3}))
        if run:
            (at / "run.json").write_text("{}")
    (tmp_path / "m" / "e1" / "training_run.json").write_text('{"seed": 1}')
    got = {r["evidence"].split("/m/")[1]: (r["training"], r["missing"]) for r in files.read_evidence(spark, str(tmp_path)).collect()}
    assert got == {"e1/c1/v": ('{"seed": 1}', []), "e1/c1/g": ('{"seed": 1}', ["run.json"]), "e2/c1/v": (None, ["training_run.json"])}
    assert files.tree_stats(spark, str(tmp_path)).first()["files"] == 6


def test_roles_are_gated(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": 1, "en": "a", "vi": "b"}')
    paths = {"train": str(tmp_path / "t.jsonl"), "it_test": str(tmp_path / "nowhere")}
    assert files.read_role(spark, paths, "train", frozenset({"train"})).count() == 1
    with pytest.raises(PermissionError):
        files.read_role(spark, paths, "it_test", frozenset({"train"}))


def test_adapter_keeps_order_nulls_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, ""), (4, "f g")], "id long, text string")
    got = adapters.translated(rows, "text", "out", lambda: lambda xs: [x.upper() + "." for x in xs], lambda t: t.split()[::1], batch=3).collect()
    assert {r["id"]: r["out"] for r in got} == {1: "A. B. C. D. E.", 2: None, 3: "", 4: "F. G."}
    with pytest.raises(Exception, match="an output for each segment"):
        adapters.translated(rows, "text", "out", lambda: lambda xs: xs[1:], str.split).collect()
