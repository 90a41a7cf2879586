"""Operators against brute force, and their edge cases."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from corpusloom.llm import decontaminate, jaccard_join, licences, mixing, pii, quality_model, quality_rules, substring_dedup, token_counts, url_filters
from corpusloom.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], DOCS)


EDGE = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "one two", None), (5, "\n\n", None), (6, "é" * 5000, "b"), (7, "w " * 30000, "b")]
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.mark.parametrize("rows", [EDGE, []])
def test_edge_cases(spark, rows):
    d = docs(spark, rows)
    n = len(rows)
    bench = spark.createDataFrame([(1, "one two"), (2, None), (None, "")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(d).count() == n
    assert pii.detect(d).count() == n
    assert {r.score for r in quality_model.classify(d, labels).collect()} <= {0.5}
    assert token_counts.count_tokens(d, [b"w", b" w"]).count() == n
    assert licences.scan_documents(d).count() == n
    assert jaccard_join.classes(d).count() == n
    found = {r.doc_id: r for r in decontaminate.summary(decontaminate.find(d, bench)).collect()}
    assert len(found) == len({r[0] for r in rows}) and (not rows or (found[None].n_hit, found[7].contaminated) == (2, False))
    assert substring_dedup.passages(d).count() == n
    assert quality_rules.judge(d)[0].count() == n
    for stage in (quality_rules.filtered, jaccard_join.deduplicated, lambda x: decontaminate.decontaminated(x, bench), pii.redacted):
        assert stage(d).columns == d.columns
    assert mixing.mixed(d).count() <= n


def test_pages_edges(spark):
    rows = [(1, None, None), (2, "nothing", "x"), (3, "http://EXAMPLE.com/en/1?q", None), (3, "http://EXAMPLE.com/en/1?q", None), (4, "s://www.example.com/en/", ""), (5, "http://a.net/es/x", "see b.org."), (6, "http://b.org", "b.org a.net"), (7, "http://c.org#f", "www.example.com")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(p).collect()}
    assert got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[4] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[5][2:] == ("net/es/", "block")
    assert got[6] == ("b.org", "", None, "block")  # it links to a blocked host
    assert got[7] == ("c.org", "", None, "allow")
    assert url_filters.judge(p.limit(0)).count() == 0


def test_pagerank_equals_power_iteration(spark):
    rng = random.Random(3)
    edges = [(a, b, rng.randint(1, 4)) for a in range(8) for b in range(8) if a != b and rng.random() < 0.4]
    e = spark.createDataFrame([("trust", str(a), str(b), w / sum(x for s, _, x in edges if s == a)) for a, b, w in edges], "kind string, src string, dst string, w double")
    s = spark.createDataFrame([("trust", "0", 0.75), ("trust", "3", 0.25)], "kind string, host string, seed double")
    got = {int(r.host): r.score for r in url_filters.propagate(s, e, steps=6).collect()}
    seed = np.array([0.75, 0, 0, 0.25, 0, 0, 0, 0])
    m = np.zeros((8, 8))
    for a, b, w in edges:
        m[b, a] = w / sum(x for t, _, x in edges if t == a)
    rank = seed
    for _ in range(6):
        rank = 0.85 * m @ rank + 0.15 * seed
    assert all(abs(got.get(i, 0) - rank[i]) < 1e-9 for i in range(8))


def test_mix_is_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(prose(rng, rng.randint(1, 60))), rng.choice("aaaaaaabcd")) for i in range(400)]
    got = mixing.mix(docs(spark, rows)).collect()
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abcd"}
    cap, weight = {s: 3 * size[s] for s in "abcd"}, dict(zip("abcd", (5, 2, 1, 5), strict=True))
    left, open_, target = float(sum(size.values())), set("abcd"), {}
    while True:
        rate = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if cap[s] < rate * weight[s]]
        if not over:
            target |= {s: rate * weight[s] for s in open_}
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
            open_.remove(s)
    of = {i: s for i, _, s in rows}
    for s in "abcd":
        mine = [r for r in got if of[r.doc_id] == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] and r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 31


def brute_spans(text):
    def luhn(x):
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(x)))) % 10 == 0

    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    )
    found = [(m.start(), m.end(), k) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    bits = ["a@b.c", "@", "x.y%", "1.2.3.4", "256.1.1.1", "001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", " ", "-", ".", "9", "é", "a@b", "a@b-.c.d@e.f", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert [s[:3] for s in pii.find_spans(text) if s[2] in pii.BASE] == brute_spans(text), text


def test_added_kinds_and_redaction():
    text = "my IBAN is GB82 WEST 1234 5698 7654 32 ok; ssn 123-45-6789; code 123-45-6780"
    kinds = [s[2] for s in pii.find_spans(text)]
    assert "iban" in kinds and kinds.count("ssn") == 2
    assert pii.find_spans("part 123-45-6789 only") == [] and pii.redact("to a@b.co now") == "to <EMAIL> now"


def test_classifier_on_held_out_rows(spark):
    rng, rows, lab = random.Random(2), [], []
    for i in range(900):
        bad = rng.random() < 0.3
        words = prose(rng, rng.randint(20, 80))
        rows.append((i, " ".join(w + "###" if bad and rng.random() < 0.6 else w for w in words), "a"))
        lab.append((i, 0 if bad else 1, 0))
    labels = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs(spark, rows), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == lab[r.doc_id][1] for r in held) >= 0.97 * len(held)


def test_token_counts_equal_greedy(spark):
    vocab = [b" a", b"ab", b"abc", b"b", b"c", b"a", b" ab", b"bca"]

    def greedy(word):
        s, at, n = b" " + word, 0, 0
        while at < len(s):
            for end in range(len(s), at, -1):
                if s[at:end] in vocab:
                    at, n = end, n + 1
                    break
            else:
                return None
        return n

    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("abcd" if i % 9 == 0 else "abc") for _ in range(rng.randint(1, 9))) for _ in range(20)), "s") for i in range(40)]
    for r in token_counts.count_tokens(docs(spark, rows), vocab).collect():
        counts = [greedy(w.encode()) for w in rows[r.doc_id][1].split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (20, sum(1 if c is None else c for c in counts), sum(c is None for c in counts))


def test_licences_are_inherited(spark):
    files = spark.createDataFrame([
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.c", "int main"), (3, "a/b/COPYING", "# Licensed under the Apache License, Version 2.0"),
        (4, "a/b/c/y.c", "code\nmore"), (5, "z.c", "the terms and conditions of this work are general"), (6, "a/w.c", "// This work is licensed under the GNU General Public License, version 3."),
    ], "key long, path string, text string")
    got = {r.key: (r.own_licence, r.licence, r.inherited_from) for r in licences.scan(files).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "Apache-2.0", "a/b"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, "Apache-2.0", "a/b"), 5: (None, None, None), 6: ("GPL-3.0", "GPL-3.0", None)}


def test_licence_prefilter_loses_no_unit(spark):
    """Lines, blocks and files with template words, strangers and repeats: the same licences as by plain TF-IDF cosines."""
    rng, model = random.Random(1), licences.Model(licences.known_templates(), licences.THRESHOLD)
    texts = [v for vs in licences.known_templates().values() for v in vs]
    words = [w for v in texts for w in v.split()]
    rows = []
    for i in range(400):
        base = rng.choice(texts).split()
        x = base[: rng.randrange(1, len(base) + 1)] + [rng.choice([*words, "zzz", "zzz", f"foo{rng.randrange(50)}"]) for _ in range(rng.randrange(12))]
        if rng.random() < 0.7:
            rng.shuffle(x)
        x = x * rng.choice((1, 1, 2))
        rows.append((i, f"d{i}/x", " ".join(w + rng.choice(("", "", "", "", "", "\n", "\n# ", "\n//\n")) for w in x)))

    def own(text):
        units = [text, *text.split("\n"), *re.split(r"\n[^A-Za-z0-9]*\n", text)]
        best = (0, 0, "")
        for u in units:
            x = {}
            for t in re.findall("[a-z0-9]+", u.lower()):
                x[t] = x.get(t, 0) + model.idf.get(t, model.unseen)
            norm = sum(v * v for v in x.values()) ** 0.5 or 1
            best = max(best, *((round(sum(v * w.get(t, 0) for t, v in x.items()) / norm, 9), -k, model.names[k]) for k, w in enumerate(model.weights)))
        return best[2] if best[0] >= licences.THRESHOLD else None

    got = {r.key: r.own_licence for r in licences.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    want = {k: own(t) for k, _, t in rows}
    assert got == want and sum(v is not None for v in want.values()) > 50


def test_whole_licence_files_headers_tags_and_rows_of_one_key(spark):
    from corpusloom.llm import licence_texts

    apache = "/*\n * Copyright 2020 Some One\n *\n" + "\n".join(f" * {x}" for x in licence_texts.BLOCKS["Apache-2.0"][0].split("\n")) + "\n *\n */\nint main() { return 0; }\n"
    gpl = "".join(f"# {x}\n" for x in licence_texts.BLOCKS["GPL-3.0"][0].split("\n")) + "\nimport os\n"
    mit = "MIT License\n\nCopyright (c) 2021 A. N. Author\n\n" + "\n\n".join((licence_texts._MIT, licence_texts._MIT_NOTICE, licence_texts._WARRANTY_MIT))
    bsd = "Copyright (c) 2019, B\n\n" + licence_texts.FILES["BSD-3-Clause"][1]
    copying = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\n"
    files = [(1, "m/LICENSE", mit), (2, "m/src/a.c", "int x;"), (3, "p/a.c", apache), (4, "q/b.py", gpl), (5, "b/LICENSE.txt", bsd), (6, "t/a.rs", "// SPDX-License-Identifier: MIT\nfn main() {}"), (7, "c/COPYING", copying), (8, "u/a.rs", "// SPDX-License-Identifier: Nothing-9\n"), (9, "x", "the software of the work is here and to be used"), (10, "same", "Released under the MIT License."), (10, "same", "nothing here")]
    got = licences.scan(spark.createDataFrame(files, "key long, path string, text string")).collect()
    by = {r.key: r.own_licence for r in got if r.key < 10}
    assert by == {1: "MIT", 2: None, 3: "Apache-2.0", 4: "GPL-3.0", 5: "BSD-3-Clause", 6: "MIT", 7: "GPL-3.0", 8: None, 9: None}
    assert sorted(str(r.own_licence) for r in got if r.key == 10) == ["MIT", "None"]
    assert [(r.licence, r.inherited_from) for r in got if r.key == 2] == [("MIT", "m")]


def test_licences_are_inherited_as_by_walking_up(spark):
    rng = random.Random(3)
    said = {"MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", None: "int x"}
    rows = [(i, "/".join(rng.choice("ab") for _ in range(rng.randrange(5))) + f"/{rng.choice(('LICENSE', 'x.c', 'y.c', 'z.c'))}", rng.choice(list(said))) for i in range(60)]
    rows = list({p: (i, p, x) for i, p, x in rows}.values())
    stated = {}
    for d in {p.rpartition("/")[0] for _, p, _ in rows}:
        mine = [(p, x) for _, p, x in rows if p.rpartition("/")[0] == d and x]
        files = sorted((p, x) for p, x in mine if p.endswith("LICENSE"))
        if files:
            stated[d] = files[0][1]
        elif len(mine) >= licences.AGREE and len({x for _, x in mine}) == 1:
            stated[d] = mine[0][1]

    def want(p, x):
        d = p.rpartition("/")[0]
        while x is None:
            if d in stated:
                return stated[d], d
            if not d:
                break
            d = d.rpartition("/")[0]
        return x, None

    got = {r.key: (r.licence, r.inherited_from) for r in licences.scan(spark.createDataFrame([(i, p, said[x]) for i, p, x in rows], "key long, path string, text string")).collect()}
    assert got == {i: want(p, x) for i, p, x in rows} and any(v[1] is not None for v in got.values())


def shingle_set(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def varied(rng, base, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in base]


def test_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng, texts = random.Random(7), []
    for _ in range(6):
        base = prose(rng, 120)
        texts += [" ".join(varied(rng, base, rng.choice((0, 0, 0.01, 0.02, 0.05)))) for _ in range(14)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    sets = {i: shingle_set(t) for i, t, _ in rows}
    links = {i: set() for i in sets}
    for a, b in combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a].add(b)
            links[b].add(a)
    label = {i: i for i in sets}
    for _ in sets:
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in sets}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.classes(docs(spark, rows)).collect()}
    assert got == {i: (label[i], len(links[i])) for i in sets}
    kept = {r.doc_id for r in jaccard_join.deduplicated(docs(spark, rows + rows[:3])).collect()}
    assert kept == set(label.values())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)}


def test_decontamination_in_blocks(spark):
    rng = random.Random(8)
    items = [(i, " ".join(prose(rng, rng.choice((4, 12, 25))))) for i in range(12)]
    rows = [(i, " ".join(prose(rng, 30) + items[i % 12][1].split() + prose(rng, 10)), "s") for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, rows)
    whole = decontaminate.summary(decontaminate.find(d, bench)).orderBy("doc_id").collect()
    assert whole == decontaminate.summary(decontaminate.find(d, bench, block_words=20)).orderBy("doc_id").collect()
    assert all(r.contaminated and r.n_hit >= len(items[r.doc_id % 12][1].split()) for r in whole)
    clean = decontaminate.decontaminated(d, bench)
    assert not any(r.contaminated for r in decontaminate.summary(decontaminate.find(clean, bench)).collect())


def test_passages_are_found_and_clean_texts_left(spark):
    rng, shared = random.Random(9), prose(random.Random(10), 70)
    rows = [(i, " ".join(prose(rng, 89) + [f"b{i}"] + (shared if i % 3 == 0 else []) + [f"e{i}"] + prose(rng, 60)), "s") for i in range(30)]
    near = varied(rng, shared, 0.0)
    near[35] = "other"
    rows.append((99, " ".join(prose(rng, 79) + ["b99"] + near + ["e99"] + prose(rng, 20)), "s"))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substring_dedup.passages(docs(spark, rows)).collect()}
    assert all(got[i] == ([(90, 160)] if i % 3 == 0 else []) for i in range(30)) and got[99] == [(80, 150)]


def test_rules_remove_boilerplate_but_not_copies(spark):
    rng = random.Random(11)
    line = "click here to subscribe now"
    rows = [(i, " ".join(prose(rng, 30)) + "\n" + line, "h") for i in range(60)] + [(100 + i, "the same text of a copy with more than ten words in it", "h") for i in range(60)]
    rows += [(300, line + "\n" + line + " ", "h"), (301, "tiny", "h")]
    verdicts, _ = quality_rules.judge(docs(spark, rows))
    got = {r.doc_id: r for r in verdicts.collect()}
    assert all(got[i].left_words == 30 and got[i].kept for i in range(60)) and all(got[100 + i].kept for i in range(60))
    assert not got[301].kept and got[301].base_failed
    kept = {r.doc_id: r for r in quality_rules.filtered(docs(spark, rows)).collect()}
    assert line not in kept[0].text and kept[0].n_chars == len(kept[0].text) and 301 not in kept


def test_pipeline_equals_its_parts_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    passage = prose(rng, 15)
    rows = [(i, " ".join(prose(rng, 60) + (passage if i % 5 == 0 else []) + (["mail", f"x{i}@y.org"] if i % 4 == 0 else [])), "ab"[i % 2]) for i in range(40)]
    rows += [(50 + i, rows[i][1], "a") for i in range(5)] + [(60, "short", "a")]
    docs(spark, rows).drop("hash").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {}
    for i, text, source in rows[:40]:
        text = text.replace(" ".join(passage), "")
        for a, b, k in reversed(brute_spans(text)):
            text = text[:a] + f"<{k.upper()}>" + text[b:]
        want[i] = (text, source)
    assert {r.doc_id for r in out} <= set(want)
    assert all((r.text, r.source) == want[r.doc_id] and r.taken == r.copies * len(r.text.split()) for r in out)
