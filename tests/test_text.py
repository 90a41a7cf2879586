from pyspark.sql import functions as F

from corpusloom.functions import sequences as Q
from corpusloom.functions import text as T


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_clean_and_keys(spark):
    rows = [("  a  b\t",), ("é",), ("Straße ﬁ",), (None,)]
    got = one(spark, rows, "t string", T.clean(F.col("t")), T.match_key(F.col("t")))
    assert got == [("a b", "a b"), ("é", "é"), ("Straße ﬁ", "strasse fi"), (None, None)]


def test_input_normalization_deletes_controls(spark):
    assert one(spark, [("\x00a\x1c�b\x85",)], "t string", T.input_normalized(F.col("t"))) == [("a b",)]


def test_pair_hash_is_of_compact_json(spark):
    import hashlib
    import json

    a, b = 'x"\\é', "y\n"
    want = hashlib.sha256(json.dumps([a, b], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, [(a, b)], "a string, b string", T.pair_hash(F.col("a"), F.col("b"))) == [(want,)]


def test_tags_and_groups(spark):
    rows = [("Click the button", "x"), ("sudo apt-get update", "x"), ("plain words", "only"), ("please wait", "x"), ("see /usr/local/bin", "lỗi"), ("version 1.2.3", "x")]
    tags = T.tags(F.col("a"), F.col("b"))
    got = one(spark, rows, "a string, b string", tags, T.group_of(F.col("a"), F.col("b"), tags)["primary_group"], T.group_of(F.col("a"), F.col("b"), tags)["group_method"])
    assert [x[1] for x in got] == [T.GROUPS[1], T.GROUPS[0], T.GROUPS[3], T.GROUPS[2], T.GROUPS[2], T.GROUPS[3]]
    assert [x[2] for x in got] == ["rule_based", "rule_based", "default_group", "rule_based", "rule_based", "rule_based"]
    assert got[4][0] == ["has_error", "has_path"]


def test_title_bucket_paths(spark):
    assert one(spark, [("  " + "x" * 70 + "\nmore",)], "t string", T.title(F.col("t"))) == [("x" * 59 + "…",)]
    got = one(spark, [("a/b",), ("../a",), ("/a",), ("a//b",), ("",), ("a\\b",)], "p string", T.safe_relative_path(F.col("p")))
    assert [x[0] for x in got] == [True, False, False, False, False, False]


def test_syllables(spark):
    words = [("nghieng",), ("toi",), ("hello",), ("cam",), ("string",), ("a",), ("maon",), ("quyen",)]
    assert [x[0] for x in one(spark, words, "w string", T.is_bare_syllable(F.col("w")))] == [True, True, False, True, False, True, False, True]


def test_loops():
    assert Q.collapsed_loops("please please please please please please.") == "please."
    assert Q.collapsed_loops("go go go") == "go go go"
    assert Q.collapsed_loops("a  b c") == "a  b c"
    assert Q.collapsed_loops("x a b a b a b a b y") == "x a b y"


def test_transcripts_and_chunks():
    assert Q.transcript("um i i i want i want tea", "en") == "I want tea"
    assert Q.transcript("go go", "en") == "Go go"
    assert Q.speech_chunks("One two three four, five six. Seven!") == ["One two three four,", "five six.", "Seven!"]
    for text in ("", "a b  c", "x" * 50 + " y", "  lead"):
        pieces = Q.lossless_segments(text, 7)
        assert "".join(pieces) == text and all(len(p) <= 7 for p in pieces)


def test_policy_segments():
    fits = lambda s: len(s) <= 12
    assert Q.policy_segments("Short one.", fits) == ["Short one."]
    assert Q.policy_segments("One two. Three. Four five six seven", fits) == ["One two.", "Three.", "Four five", "six seven"]
    assert Q.policy_segments("a" * 30 + " b", fits) == ["a" * 12, "a" * 12, "a" * 6, "b"]
    assert Q.policy_segments("keep `a b c d` whole", fits, lambda t: [(5, 14)]) == ["keep", "`a b c d`", "whole"]


def test_speakable():
    assert Q.speakable("Python 3.12 dùng API a_b", "vi", {"python": "pai thần"}) == "pai thần 3 chấm 12 dùng ây pi ai a b"
    assert Q.speakable("VIỆT API", "vi", None) == "VIỆT API"
    assert Q.speakable("use getUser_id 1.5", "en") == "use get User id 1 point 5"
    assert Q.speech_chunks("Wait; then go: now") == ["Wait;", "then go:", "now"]


def test_placeholders():
    forms = Q.parse_forms(["# c", "", "React\tReactJS\ten_common\ten_to_vi\t", "Python\t\t\ten_to_vi\tlower@vi_to_en"])
    p = Q.Protector(forms)
    assert p.protect("Use React, ReactJS and python", "en_to_vi") == ("Use TERM1, TERM2 and TERM3", ["React", "ReactJS", "python"])
    assert p.protect("React is good; they react", "en_to_vi") == ("React is good; they react", [])
    assert p.protect("dùng python", "vi_to_en") == ("dùng Python", [])
    assert p.protect("at /usr/bin/python and python.org", "en_to_vi")[1] == []
    assert p.protect("TERM1 python", "en_to_vi") == ("TERM1 python", [])
    assert Q.restored("x TERM2 TERM1", ["a", "b"]) == "x b a" and Q.restored("TERM1 TERM1", ["a", "b"]) is None and Q.restored("x", []) == "x"


def test_signals():
    import numpy as np

    x = np.ones(4000)
    x[2600:3000] = 0
    pieces = Q.quiet_pieces(x, 3000, 1000, 256)
    assert pieces[0][0] == 0 and 2600 <= pieces[0][1] <= 3000 and pieces[-1][1] == 4000 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
    t = np.sin(np.arange(4000) / 5)
    assert Q.spectral_distance(t, t) == 0 and Q.spectral_distance(t, np.sin(np.arange(4000) / 2)) > 1 and Q.spectral_distance(t, [0.0]) is None


def test_subwords(spark):
    from corpusloom.functions.subwords import Codec

    codec = Codec("/opt/tokenizers/piece_bpe_32k.model", pad="<s>")
    texts = [("Hello, how are you?",), ("naïve café",), ("",), (None,)]
    x = spark.createDataFrame(texts, "t string").select("t", codec.encoded(F.col("t")).alias("ids"), codec.length(F.col("t")).alias("n"))
    got = x.select("t", "ids", "n", codec.decoded(F.col("ids")).alias("back")).collect()
    assert [r.back for r in got] == [r.t for r in got] and [r.n for r in got] == [len(r.ids) if r.ids is not None else None for r in got]
    assert got[0].ids[-1] == 2 and codec.encode("a</s>")[-2:] == [2, 2]
    assert Codec("/opt/tokenizers/piece_bpe_32k.model", prefix=">>vie<<", vocab=("<unk>", "</s>", "<pad>", ">>vie<<", "▁a")).encode("a b") == [3, 4, 0, 1]
