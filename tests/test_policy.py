import pytest
from pyspark.sql import functions as F

from corpusloom.functions import literals as L
from corpusloom.functions import policy as P

LEXICON = L.Lexicon(["API", "CI/CD"], ["JavaScript", "Node.js", "Python", "jQuery"], ["React"], ["commit", "pull request"], {"en_to_vi": ["ok", "hello"], "vi_to_en": ["ok", "chào"]})
POLICY = P.Policy(LEXICON)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("API?", "ACRONYM"), ("APIs", "ACRONYM"), ("API returns timeout", None), ("javascript", "TECHNOLOGY"), ("react", None), ("“React”", "TECHNOLOGY"),
        ('git commit -m "sửa lỗi"', "COMMAND"), ("git is a tool", None), ("make it work", None), ("brew install node", "COMMAND"), ("sudo apt install x", "COMMAND"), ("./run.sh now", "COMMAND"),
        ("await fetch('/api/users')", "CODE"), ("x => x * 2", "CODE"), ("SELECT * FROM users;", "CODE"), ("Settings -> General", None), ("haha =))", None), ("file(s)", None), ("foo()", "CODE"),
        ("Python 3.12", "TECHNOLOGY"), ("HTTP 404", "HTTP_STATUS"), ("404 Not Found", "HTTP_STATUS"), ("Hello.World", None), ("os.path", "IDENTIFIER"), ("download/install/remove", None), ("-f", "CODE"), ("", None),
    ],
)
def test_whole(text, kind):
    assert POLICY.literals.whole(text) == kind


@pytest.mark.parametrize(
    "text, spans",
    [
        ("see (http://a.b/c). ok", ["URL http://a.b/c"]), ("mail a.b@c.io, 25/8/2023", ["EMAIL a.b@c.io", "NUMBER 25/8/2023"]), ("v 14.0.0.304", ["VERSION 14.0.0.304"]), ("ping 8.8.8.8", ["URL 8.8.8.8"]), ("at 10.0.0.1", ["URL 10.0.0.1"]),
        ("open /api/users và ~/x", ["PATH /api/users", "PATH ~/x"]), ("C++ or std::vector", ["CODE std::vector"]), ("use jQuery, getUserById, my_var", ["TECHNOLOGY jQuery", "CODE getUserById", "CODE my_var"]),
        ("lỗi 500 rồi", ["HTTP_STATUS 500"]), ("in main.py --fast", ["FILE_NAME main.py", "CODE --fast"]), ("`a b` at 10:30, 5%", ["CODE `a b`", "NUMBER 10:30", "NUMBER 5%"]),
    ],
)
def test_spans(text, spans):
    found = POLICY.literals.spans(text)
    assert [f"{s.kind} {s.text}" for s in found] == spans
    assert all(text[s.start : s.end] == s.text for s in found)
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))


def test_edges():
    assert L.bare(" (“.NET”!) ") == ".NET" and L.bare("fetch().") == "fetch()" and L.bare('say "x"') == 'say "x"' and L.bare("...") == ""
    assert L.without_tail("a(b)).,") == "a(b)" and L.without_tail("...") == ""


def test_lexicon_terms_are_unique():
    with pytest.raises(ValueError):
        L.Lexicon(["API"], ["api"])
    with pytest.raises(ValueError):
        L.Lexicon(["API "])
    assert [t.text for t in LEXICON.find("APIs of node.js, React; reactor")] == ["API", "Node.js", "React"]
    assert LEXICON.find_context("a pull  request, Commit, commits") == ["pull request", "commit"]


def decide(spark, rows):
    x = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d string, o boolean, s boolean")
    f = x.withColumn("f", POLICY.input_features(F.col("t"), F.col("d")))
    out = f.select("i", P.decision(F.col("f"), F.col("d"), F.col("o"), F.col("s")).alias("r")).orderBy("i").collect()
    return [(r.r.action, r.r.notes, r.r.guess, r.r.suggested) for r in out]


def test_decisions(spark):
    en, vi = "en_to_vi", "vi_to_en"
    rows = [
        ("", en, False, False), ("x" * 501, en, False, False), ("API", en, False, False), ("commit", en, False, False), ("hello!", en, False, False), ("hello", vi, False, False), ("hello", vi, True, False),
        ("Tôi cần bạn", en, False, False), ("Tôi cần bạn", en, False, True), ("toi khong biet", vi, False, False), ("JPEG Images", en, False, False), ("word", en, False, False), (None, vi, False, False),
    ]
    assert decide(spark, rows) == [
        ("empty", [], None, None), ("too_long", [], None, None), ("keep", ["KEPT_LITERAL"], None, None), ("keep", ["CONTEXT_TERM"], None, None), ("translate", [], "en_high", None),
        ("mismatch", [], "en_high", en), ("translate", ["SHORT_INPUT", "LANGUAGE_OVERRIDDEN"], "en_high", None), ("mismatch", [], "vi_high", vi), ("translate", [], "vi_high", None),
        ("translate", ["NO_DIACRITICS"], "vi_high", None), ("translate", [], "uncertain", None), ("translate", ["SHORT_INPUT"], "uncertain", None), ("empty", [], None, None),
    ]


def test_output_checks(spark):
    rows = [
        ("a", " ", "en_to_vi"), ("go to http://X.com/a", "http://x.com/A", "en_to_vi"), ("call f(x)", "gọi f (x)", "en_to_vi"), ("error 404", "lỗi 4045", "en_to_vi"), ("open ~/a/B", "mở ~/a/b", "en_to_vi"),
        ("use Node.js and the API", "dùng Node. js", "en_to_vi"), ("commit CI/CD", "committed ci / cds", "vi_to_en"), ("commit này", "commission", "vi_to_en"), ("commit này", "x", "en_to_vi"),
    ]
    x = spark.createDataFrame(rows, "s string, o string, d string").select(POLICY.checked(F.col("s"), F.col("o"), F.col("d")).alias("c"))
    got = [tuple(r.c) for r in x.collect()]
    assert got == [
        ("empty_output", [], []), (None, [], []), (None, [], []), ("lost_literal", ["404"], []), ("lost_literal", ["~/a/B"], []),
        (None, [], ["API"]), (None, [], []), (None, [], ["commit"]), (None, [], []),
    ]


def test_evidence(spark):
    rows = [("Tôi cần fix bug",), ("I love phở in Hà Nội",), ("cam on ban",), ("Pokémon José",), (None,)]
    e = POLICY.language_evidence(F.col("t"))
    got = [tuple(r.e) for r in spark.createDataFrame(rows, "t string").select(e.alias("e")).collect()]
    assert got == [(2, 0, 0, 0, 2), (1, 0, 0, 2, 1), (0, 3, 0, 0, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)]


def test_skipped_patterns_never_match(monkeypatch):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    bits = st.sampled_from("a B 1 . / : = ( ) @ _ - < > ` ~ \\ http www file vn com localhost Dockerfile error 404 é :: --x ++".split() + [" "])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(bits, max_size=14).map("".join))
    def check(text):
        quick = POLICY.literals.spans(text)
        with monkeypatch.context() as m:
            m.setattr(L, "NEEDS", dict.fromkeys(L.PATTERNS, ("",)))
            assert POLICY.literals.spans(text) == quick

    check()
