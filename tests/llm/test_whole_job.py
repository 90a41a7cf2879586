"""Cases that the operators lost before they did the whole job."""

import random
import re
import uuid

import numpy as np
import pytest

from corpusloom.llm import decontaminate, pii, quality_rules, substring_dedup, url_filters


@pytest.mark.parametrize("before, iban, after", [
    ("IBAN ", "DE89370400440532013000", " BIC COBADEFFXXX"), ("Konto ", "DE89 3704 0044 0532 0130 00", " Please pay"), ("IBAN ", "GB82 WEST 1234 5698 7654 32", " Bank"),
    ("", "DE89370400440532013000", " Berlin"), ("", "DE89370400440532013000", " 2024-01-02"), ("", "NO9386011117947", " 12 X"), ("AB12 ", "DE89370400440532013000", " A"), ("", "DE89370400440532013000", ""),
])
def test_an_iban_ends_at_its_countrys_length(before, iban, after):
    begin, end = len(before), len(before + iban)
    assert [s[:3] for s in pii.find_spans(before + iban + after) if s[2] == "iban"] == [(begin, end, "iban")]
    assert iban not in pii.redact(before + iban + after)


def test_ibans_side_by_side_and_wrong_ones():
    a, b = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    assert pii.redact(f"{a} {b} X") == "<IBAN> <IBAN> X"
    assert pii.find_spans("DE88370400440532013000 Berlin") == [] and pii.find_spans("DE89370400440532013000Berlin") == []


def test_runs_of_iban_characters_stay_linear():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("AB12") for _ in range(rng.randint(1, 6))) for _ in range(100_000))
    list(pii.ibans(text))


def test_cutting_in_blocks_equals_cutting_at_once(spark):
    rng = random.Random(3)
    passages = [[f"p{k}x{i}" for i in range(40)] for k in range(6)]
    items = [(10 * k + j, " ".join(p[6 * j : 6 * j + 14])) for k, p in enumerate(passages) for j in range(5)]
    rows = [(i, " ".join([f"a{rng.randrange(99)}"] * 20 + passages[i % 6] + [f"b{rng.randrange(99)}"] * 20)) for i in range(24)]
    rows += [rows[0], (None, rows[1][1]), (50, None), (51, "clean text")]
    d = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = lambda block_words: sorted(map(str, decontaminate.decontaminated(d, bench, block_words=block_words).collect()))
    assert decontaminate.n_blocks(bench, "item_id", "text", 400) > 1
    assert got(400) == got(decontaminate.BLOCK_WORDS)


def test_a_line_of_least_hash_is_boilerplate_too(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    least = min((f"read more in part {i}" for i in range(20_000)), key=lambda x: quality_rules.line_id(x.encode()) & 0xFFFFFFFFFFFFFFFF)
    rows = [(i, prose(30) + "\n" + least, "h") for i in range(60)]  # unrelated, but one line
    copy = prose(100)
    rows += [(100 + i, f"{copy}\nthe end of this text\n{prose(2)}", "h") for i in range(60)]  # near copies
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.left_words for r in quality_rules.judge(d)[0].collect()}
    assert {got[i] for i in range(60)} == {30} and {got[100 + i] for i in range(60)} == {107}


def test_distrust_reaches_far_hosts_and_all_link_targets(spark):
    chain = [("http://h0.bad/", "")] + [(f"http://h{i}.org/", f"http://h{i - 1}.{'bad' if i == 1 else 'org'}/") for i in range(1, 18)]
    odd = [("http://a_b:81/x", ""), ("http://localhost/", ""), ("http://é.bad2/", ""), ("http://x.org", "<a href='http://A_B:81/y'>"), ("http://y.org", "see http://localhost."), ("http://z.org", '"http://é.bad2?q"')]
    p = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(chain + odd)], "page_id long, url string, html string")
    rules = [("block", h, "/") for h in ("h0.bad", "a_b:81", "localhost")] + [("block", "é.bad2", "")]
    got = {r.host: r.verdict for r in url_filters.judge(p, rules=rules).collect()}
    assert [h for h, v in got.items() if v != "block"] == []


def brute_passages(texts):
    """For each text the words in subsequences of TOKENS shingles of which 80 % are in one other text, trimmed to such."""
    n, need = substring_dedup.TOKENS, 37
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    out = []
    for a, w in enumerate(texts):
        hit = set()
        for b, other in enumerate(sets):
            if a != b and texts[a] != texts[b]:
                flags = [tuple(w[i : i + 5]) in other for i in range(len(w) - 4)]
                for s in range(len(flags) - n + 1):
                    if sum(flags[s : s + n]) >= need:
                        shared = [i for i in range(s, s + n) if flags[i]]
                        hit.update(range(shared[0], shared[-1] + 5))
        out.append(hit)
    return out


def test_passages_against_all_pairs_and_mosaics(spark):
    """Repeats, near repeats and common lines: recall and precision by words. Mosaics of many documents are left alone."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(900)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    common = [prose(14) for _ in range(3)]
    passages = [prose(rng.choice((50, 52, 60, 90))) for _ in range(25)]
    texts = []
    for i in range(150):
        w = prose(rng.randint(30, 90))
        if i % 2:
            p = list(passages[rng.randrange(25)])
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                p[rng.randrange(len(p))] = f"x{rng.randrange(10**6)}"
            w += p + prose(rng.randint(10, 40))
        w += rng.choice(common) if i % 3 else []
        texts.append(w + prose(20))
    mosaics = [sum((texts[rng.randrange(0, 150, 2)][k : k + 26] for k in rng.choices(range(4), k=16)), []) for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts + mosaics)]
    got = {r.doc_id: {k for s in r.spans for k in range(s.start, s.end)} for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_passages(texts + mosaics)
    found = sum(len(got[i] & w) for i, w in enumerate(want))
    assert found >= 0.97 * sum(map(len, want)) and found >= 0.97 * sum(map(len, got.values()))
    recall = [bool(got[i]) for i, w in enumerate(want) if w]
    assert len(recall) > 50 and sum(recall) >= 0.97 * len(recall)
    assert not any(got[i] for i, w in enumerate(want) if not w)


def test_judged_pages_equal_a_dense_computation(spark):
    """Rules, hosts and edges by plain Python, scores by iterating matrices with what dangling hosts hold going to the seeds."""
    rng = random.Random(5)
    hosts = [f"h{i}.{rng.choice(('com', 'org', 'net'))}" for i in range(20)] + ["www.example.com", "example.com", "a.b.net"]
    far = ["evil.net", "good.com", "plain.io"]  # no pages; evil.net has a rule of its own
    rules = [*url_filters.RULES, ("block", "evil.net", "/")]
    rows = []
    for i in range(90):
        links = rng.choices(hosts + far, k=rng.randrange(4))
        html = " ".join(rng.choice(('<a href="http://{}/x">', "<link rel=canonical href='//{}/'>", "see {} now", '<a href="/en/{}">', "HTTP://{}.")).format(h.upper() if rng.random() < 0.2 else h) for h in links)
        rows.append((i, f"https://{rng.choice(hosts)}/{rng.choice(('en/', 'es/', 'x', ''))}", html))

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, default=(0, None, None))[1:]

    split = lambda u: (u.split("//")[1].split("/")[0], "/" + u.split("//")[1].split("/", 1)[1])
    known = {split(u)[0] for _, u, _ in rows}
    edges, seeds = {}, {"allow": {}, "block": {}}
    for _, u, html in rows:
        src, low = split(u)[0], html.lower()
        linked = {x.rstrip(".") for x in re.findall(r"//([^/ ]+)", low)}
        named = set(re.findall(r"[a-z0-9-]+\.[a-z0-9.-]*[a-z0-9]", low)) & known
        for dst in (linked | named) - {src}:
            edges[src, dst] = edges.get((src, dst), 0) + 1
        v = rule(*split(u))[1]
        if v:
            seeds[v][src] = seeds[v].get(src, 0) + 1
    for dst in {d for _, d in edges} - known:
        if v := rule(dst, "/")[1]:
            seeds[v][dst] = 1
    names = sorted(known | {d for _, d in edges})
    at = {h: i for i, h in enumerate(names)}
    score = {}
    for kind, of in seeds.items():
        s = np.zeros(len(names))
        for h, n in of.items():
            s[at[h]] = n
        s /= s.sum()
        m = np.zeros((len(names), len(names)))
        for (a, b), n in edges.items():
            a, b = (a, b) if kind == "allow" else (b, a)
            m[at[b], at[a]] = n
        out = m.sum(0)
        m[:, out > 0] /= out[out > 0]
        r = s
        for _ in range(400):
            r = 0.85 * (m @ r + r[out == 0].sum() * s) + 0.15 * s
        score[kind] = r
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=rules).collect()
    assert len(got) == len(rows)
    for r in got:
        _, u, _ = rows[r.page_id]
        host, path = split(u)
        who, v = rule(host, path)
        t, d = score["allow"][at[host]], score["block"][at[host]]
        assert (r.host, r.path, r.rule) == (host, path, who)
        assert abs(r.trust - t) < 1e-6 and abs(r.distrust - d) < 1e-6
        assert r.verdict == (v or ("block" if d > t else "allow"))
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_passages_equal_all_pairs_whatever_the_witnesses(spark):
    """Pieces of a text are common, each among other texts, and only one text has them side by side: the witnesses of the pieces
    differ. With copies, hot values and hot groups the words are those of all pairs."""
    rng = random.Random(33)
    words = [f"w{i}" for i in range(5000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    texts = []
    for _ in range(2):
        pieces = [prose(28) for _ in range(4)]
        whole = sum(pieces, [])
        texts += [prose(60) + whole + prose(60), prose(10) + whole + prose(90), whole[:70] + prose(40) + pieces[3]]
        for p in pieces:
            texts += [prose(rng.randint(30, 60)) + p + prose(rng.randint(30, 60)) for _ in range(16)]
    line = prose(12)
    texts += [prose(40) + line + prose(60) for _ in range(16)]
    long_ = prose(80)
    texts += [prose(rng.randint(5, 30)) + long_[rng.randint(0, 15) : rng.randint(65, 80)] + (line if i % 2 else []) + prose(20) for i in range(24)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    copied = [(10_000 + k, rows[5][1]) for k in range(30)] + [(20_000, "too short to be a passage"), (20_001, "too short to be a passage"), rows[9]]
    d = spark.createDataFrame(rows + copied, "doc_id long, text string")
    got = {r.doc_id: {k for s in r.spans for k in range(s.start, s.end)} for r in substring_dedup.passages(d).collect()}
    want = dict(enumerate(brute_passages(texts)))
    want |= {i: set(range(len(t.split()))) if i < 20_000 and i != 9 else set() for i, t in copied if i != 9} | {5: set(range(len(texts[5])))}
    assert sum(map(bool, want.values())) > 25
    assert {i: w for i, w in want.items() if got[i] != w} == {}


def test_near_copies_need_not_meet_in_all_pairs(spark, tmp_path, monkeypatch):
    """The words are those of all pairs, but the stretches that meet whole texts grow with the group, not with its square."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    base, texts = prose(130), []
    for i in range(240):
        w = list(base)
        for k in rng.sample(range(130), 4):
            w[k] = f"x{i}y{k}"
        texts.append(prose(10) + w)
    compared, folder = substring_dedup._compared, str(tmp_path)

    def counted(batches):
        n = []

        def seen():
            for b in batches:
                n.append(b.num_rows - b.column("key").null_count)
                yield b

        yield from compared(seen())
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(sum(n)))

    monkeypatch.setattr(substring_dedup, "_compared", counted)
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: {k for s in r.spans for k in range(s.start, s.end)} for r in substring_dedup.passages(d).collect()}
    assert {i: w for i, w in enumerate(brute_passages(texts)) if got[i] != w} == {}
    met = sum(int(p.read_text()) for p in tmp_path.iterdir())
    assert 0 < met <= 20 * len(texts)
