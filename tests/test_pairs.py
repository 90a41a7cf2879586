from corpusloom.operators import metrics
from corpusloom.operators import pairs as P

RAW = "source_short_name string, raw_row_index long, en string, vi string, category string"


def test_category_filter_comes_after_dedup(spark):
    rows = [("a", 1, "Hi", "Chao", "no"), ("a", 2, "Hi ", "Chao", "yes"), ("a", 3, "Bye", "Tam biet", "yes"), ("a", 4, None, "x", "yes"), ("a", 5, "\x01", "x", "yes")]
    got = P.cleaned(spark.createDataFrame(rows, RAW), {"a": ["yes"]}).collect()
    assert [r.raw_row_index for r in got] == [3]


def test_release_has_no_leakage(spark):
    rows = [("s", i, f"Text {i % 40}", f"Ban {i}", None) for i in range(100)]
    out = P.release(spark.createDataFrame(rows, RAW))
    assert out.columns == ["dataset_row_id", "split", "source_short_name", "raw_row_index", "en_clean", "vi_clean", "primary_group", "technical_tags", "group_method", "pair_sha256", "leakage_group_id"]
    assert out.count() == 100 and out.select("dataset_row_id").distinct().count() == 100
    assert {r.shared for r in P.leakage(out).collect()} == {0}
    assert out.select("leakage_group_id", "split").distinct().count() == 40


def test_scores(spark):
    rows = [("the cat sat on the mat .", "the cat sat on the mat ."), ("a b", "a b")]
    r = metrics.corpus_scores(spark.createDataFrame(rows, "prediction string, reference string")).first()
    assert abs(r.bleu - 100) < 1e-9 and abs(r.chrf - 100) < 1e-9
    r = metrics.corpus_scores(spark.createDataFrame([("x y z w v", "p q r s t")], "prediction string, reference string")).first()
    assert r.bleu == 0 and r.chrf == 0
