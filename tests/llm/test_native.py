"""Rule ledger, mixing, secrets, URLs and components against plain Python."""
import random
import re
from collections import Counter, defaultdict
from hashlib import md5
from math import log, log2

import pytest
from pyspark.sql import functions as F

from maskfold.llm import components, mix, rules, secrets, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string, fail_bits long"


def measured(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines), len(lines) - len(set(lines)), len(inside)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    some = ["".join(rng.choice(["a ", "b ", "cé ", "\n", "\t", "#", " | ", "long-word ", "\x0b", " "]) for _ in range(rng.randrange(150))) for _ in range(60)]
    return ["", None, " \n ", "a", "a a a a", "a b c", "x y z x y z", "l\nl\nl\n\nl", "\n", "w " * 3_000, *some, some[0], some[0]]


def test_ledger(spark, texts):
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(texts)], DOC)
    led = rules.apply_policy(rules.ledger(docs), rules.POLICY)
    for r in led.collect():
        assert tuple(r[m] for m in rules.MEASURES) == measured(texts[r.doc_id])
        n, _, _, _, _, rep = measured(texts[r.doc_id])
        assert bool(r.fail_bits & 3) == (n < 50 or 100 * rep > 50 * n)
        assert r.kept == (r.fail_bits == 0)
    assert rules.ledger(docs.limit(0)).count() == 0


def test_ablation(spark):
    bits = [0, 0, 1, 2, 3, 4, 1]
    led = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
    p = rules.Policy("p", ("few_words", "symbols"))
    got = {r.rule: r for r in rules.ablation(led, [p]).collect()}
    m = 5
    for r in rules.RULES:
        if r.name in p.rules:
            b = 1 << r.bit
            assert got[r.name].failed == sum(bool(x & b) for x in bits)
            assert got[r.name].failed_alone == sum(x & m == b for x in bits)
            assert got[r.name].kept == sum(x & m == 0 for x in bits)
            assert got[r.name].kept_without == sum(x & (m - b) == 0 for x in bits)


def filled(sizes, weights, total):
    """Reshare step by step until no budget is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = set(), total
    while True:
        rest = sum(w[s] for s in names if s not in full)
        t = {s: 2 * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if s not in full and t[s] >= 2 * sizes[s]}
        if not over:
            return t
        full |= over
        left = total - sum(2 * sizes[s] for s in full)
        if len(full) == len(names):
            return {s: 2 * sizes[s] for s in names}


def draw(doc_id):
    """The uniform number of an id, as any engine can rebuild it."""
    return (int(md5(f"42|{doc_id}".encode() if doc_id is not None else b"42").hexdigest()[:13], 16) + 0.5) / 2**52


def _by_size(seen):
    out = Counter()
    for (i, t, s), n in seen.items():
        out[i, s, len((t or "").split())] += n
    return out


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["a", "a", "a", "b", None, "c", "d"]), 0) for i in range(300)]
    rows += [(7, "same words here", "b", 0)] * 3 + [(None, "no id", "c", 0), (301, None, None, 0), (302, "", "only-empty", 0)]
    docs = spark.createDataFrame(rows, DOC)
    got = mix.sample(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want = filled(sizes, mix.WEIGHTS, 1.5 * sum(sizes.values()))
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:  # the prefix in the order of the keys, then the row behind it that fits best
        copies = int(want[s] // sizes[s]) if sizes[s] else 0
        gap = int(want[s] + 0.5) - copies * sizes[s]
        inside = sorted((-log(draw(r[0])), r[0] is None, r[0] or 0, len((r[1] or "").split())) for r in rows if r[2] == s)
        while inside and inside[0][3] <= gap:
            gap -= inside.pop(0)[3]
        left = min([gap, *[abs(x[3] - gap) for x in inside if x[3]]])
        assert abs(taken[s] - int(want[s] + 0.5)) == left, s
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mix.sample(docs.repartition(3)).collect()))
    mixed = mix.mix(docs)
    assert mixed.columns == docs.columns
    words, seen = Counter(), Counter()
    for r in mixed.collect():
        words[r.source] += len((r.text or "").split())
        seen[r.doc_id, r.text, r.source] += 1
    assert words == +taken and set(seen) <= {r[:3] for r in rows}  # every mixed text is an input text
    expected = Counter()
    for r in got:
        expected[r.doc_id, r.source, r.size] += r.copies + r.more
    assert Counter({k: v for k, v in expected.items() if v}) == Counter({k: v for k, v in _by_size(seen).items() if v})
    assert mix.sample(docs.limit(0)).count() == 0 and mix.mix(docs.limit(0)).count() == 0


def test_rows_without_words_take_part_in_whole_copies(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s", 0), (2, "", "s", 0), (3, None, "s", 0), (4, "e f", "s", 0)], DOC)
    copies = {r.doc_id: r.copies for r in mix.sample(docs, share=2.0).collect()}
    got = Counter(r.doc_id for r in mix.mix(docs, share=2.0).collect())
    assert copies == {1: 2, 2: 2, 3: 2, 4: 2} and got == copies


def test_mix_of_equal_rows_and_clashing_columns(spark):
    names = "doc_id, source, text, __t, __turn, __take, __takes, __d, id, row, times, more, copies, size, rows".split(", ")
    rows = [(None, "hot", "one two\nthree  four", *[f"x{i}"] * 12) for i in range(90)] + [(i, "cold", "a\tb\n\n c " * 20 + str(i), *["y"] * 12) for i in range(40)]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = mix.mix(docs, share=0.7)
    assert got.columns == docs.columns
    done = [tuple(r) for r in got.collect()]
    assert set(done) <= set(rows)
    words = lambda rs: sum(len(r[2].split()) for r in rs)
    sizes = {s: words([r for r in rows if r[1] == s]) for s in ("hot", "cold")}
    want = filled(sizes, mix.WEIGHTS, 0.7 * sum(sizes.values()))
    assert 0 < want["hot"] < 2 * sizes["hot"] and want["hot"] % sizes["hot"]
    for s in sizes:
        assert abs(words([r for r in done if r[1] == s]) - want[s]) <= 60
    assert mix.mix(docs.withColumn("source", F.lit(None).cast("string")), share=3.0).count() == 260  # all copies of one null source
    long = spark.createDataFrame([(1, "s", "w " * 300_000), (2, "s", "x " * 10), (3, "s", None)], "doc_id long, source string, text string")
    assert all(r.text in (None, "w " * 300_000, "x " * 10) for r in mix.mix(long, share=0.9).collect())


def test_mix_prefers_good_documents(spark):
    docs = spark.createDataFrame([(i, "one two three", "s" if i < 400 else f"t{i % 3}", 0) for i in range(2_000)], DOC)
    weights = spark.createDataFrame([(i, 9.0 if i % 2 else 1.0) for i in range(2_000)], "doc_id long, weight double")
    first = [r.doc_id % 2 for r in mix.sample(docs, weights, weights=(1, 30, 30, 30), share=0.4).collect() if r.source == "s" and r.taken]
    assert first and sum(first) / len(first) > 0.7


def spans(t):
    out = []
    words = "password passwd secret token api_key apikey".split()
    either = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)
    for m in re.finditer("(" + "|".join(map(either, words)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def entropy(s, w=secrets.WINDOW):
    return max(-sum(c / len(x) * log2(c / len(x)) for c in Counter(x).values()) for x in (s[i : i + w] for i in range(max(1, len(s) - w + 1))))


def test_base_spans(spark):
    rng = random.Random(4)
    parts = ["password", "PASSWD", "Secret", "toKen", "api_key", "apikey", ":", "=", " ", '"', "'", "abcdefgh1", "é\U0001f600", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "\n", "-", "ſecret", "toKen"]
    texts = ["", None, "x" * 20_000 + " token=abcdefgh", *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400))]
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], DOC)
    for r in secrets.find(docs).collect():
        assert [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3] == spans(texts[r.doc_id] or "")
    assert secrets.find(docs.limit(0)).count() == 0


def test_entropy_spans_and_redaction(spark):
    key = "q7Zt0LxV9bKpR3mWsE5yHc8J"
    texts = {1: f"use {key} now", 2: "see 123e4567-e89b-12d3-a456-426614174000 ok", 3: "aaaaaaaaaaaaaaaaaaaaaaaa1", 4: f"é token: {key}.", 5: "example_" + key, 6: "plain words only", 7: None, 8: "chapter-one-of-the-book-12"}
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in texts.items()], DOC)
    got = {r.doc_id: [(secrets.KINDS[s.kind], s.start, s.end) for s in r.spans] for r in secrets.find(docs).collect()}
    assert got[1] == [("entropy", 4, 4 + len(key))]
    assert got[4] == [("assign", 2, 2 + len(f"token: {key}."))]
    assert not any(got[i] for i in (2, 3, 5, 6, 7, 8))
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[1] == "use [SECRET] now" and clean[4] == "é [SECRET]" and clean[7] is None and clean[2] == texts[2]
    rng = random.Random(9)
    strings = ["".join(rng.choice("abcdef0123456789XYZ") for _ in range(n)) for n in (1, 5, 19, 20, 21, 40, 90)] + ["a" * 30, "ab" * 30]
    rows = spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets.max_entropy(F.col("s")).alias("h")).collect()
    for r in rows:
        assert r.h == pytest.approx(entropy(r.s), abs=1e-9)


def test_keys_with_a_slash_or_a_word_inside_are_found(spark):
    keys = ["/q7Zt0LxV9bKpR3mWsE5yHc8J", "/Ab3+x9QzT/7uLmPw0eRk5V", "q7Zt0LxVsampleR3mWsE5yHc8J", "zQ8dUmMy4Kt1xW0pR7vN3bG", "q7ZtEXAMPLE0LxV9bKpR3mWsE5"]
    fine = ["/usr/lib/python3/dist-packages/numpy", "/2019/05/12/Some-Title_of-it/", "sample_q7Zt0LxV9bKpR3mWsE5y", "q7Zt0LxV9bKpR3mW/Example", "your-q7Zt0LxV9bKpR3mWsE5y"]
    docs = spark.createDataFrame([(i, f"see {k} now", "s", 0) for i, k in enumerate(keys + fine)], DOC)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find(docs).collect()}
    for i, k in enumerate(keys + fine):
        assert got[i] == ([(3, 4, 4 + len(k))] if k in keys else []), k


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_and_aliases(spark):
    rows = ["http://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/", "ftp://a.net/es/1", "http://net/fr/", "http://anet/fr/", "no scheme", "", None, "http://", "http://x.org", "http://x.org#f/en/", "http://b.net/fr/9", "http://b.net?/fr/", "http://a.com://b/en/", "http://example.com/EN/", "http://ÄB.net/es/", "http://q.org/1.html", "http://www.q.org/1/", "http://b.net/fr/9", "https://X.org:443/", "http://x.org/?"]
    docs = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    key = lambda u: spark.createDataFrame([(u,)], "u string").select(urls.node_key(F.col("u"))).first()[0]
    # x.org -> q.org -> b.net/fr/9 (blocked); x2 hangs on an allowed and on a blocked page
    edges = [(key("http://x.org"), key("http://q.org/1.html")), (key("http://q.org/1.html"), key("http://b.net/fr/9")), (None, "x")]
    got = {r.page_id: r for r in urls.judge(docs, spark.createDataFrame(edges, "src string, dst string")).collect()}
    for i, u in enumerate(rows):
        host, path, rule, action = judged(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if rule:
            assert got[i].verdict == action
    assert got[9].verdict == got[10].verdict == got[16].verdict == got[19].verdict == "block" and got[16].via == "alias"
    assert got[4].verdict == got[7].verdict == got[17].verdict == got[20].verdict == "allow"
    more = [*edges, (key("http://x.org"), key("https://www.example.com/en/"))]
    got = {r.page_id: r for r in urls.judge(docs, spark.createDataFrame(more, "src string, dst string")).collect()}
    assert got[9].verdict == "allow" and got[11].verdict == "block"  # an explicit allow in the group comes first
    assert urls.judge(docs.limit(0), spark.createDataFrame([], "src string, dst string")).count() == 0
    odd = docs.select(F.col("page_id").alias("__key"), F.col("url").alias("src"))
    assert urls.judge(odd, spark.createDataFrame(edges, "src string, dst string"), url="src", keep=("__key", "src")).columns[:2] == ["__key", "src"]


def test_links_in_html(spark):
    page = """<head><LINK href="/b.html?x=1&amp;y=2" rel="canonical"><meta http-equiv=refresh content="0; url=https://M.c.org/z/">
      <link rel='alternate canonical' data-href="/no" href='c.html'><META content='5;URL="../d?u=1"' http-equiv='Refresh'>
      <link rel=canonical href=//o.org><link rel=canonical href="?q"><link rel="canonical" href="mailto:a@b.c"><link rel="canonical" href="#f">
      <link rel="stylesheet" href="/s.css"><meta name="canonical" content="0; url=/no"><link rel="canonical" href=""><meta http-equiv="refresh" content="30">"""
    docs = spark.createDataFrame([(1, "http://a.org/p/q/a.html?old", page), (2, "http://a.org/q", None), (3, None, page), (4, "no scheme", page), (5, "http://a.org", '<link rel="canonical" href="x/./y/../z">' + " " * 300_000)], "page_id long, url string, html string")
    got = {(r.src, r.dst) for r in urls.link_edges(docs).collect()}
    to = {"a.org/b.html?x=1&y=2", "m.c.org/z/", "a.org/p/q/c.html", "a.org/p/d?u=1", "o.org/", "a.org/p/q/a.html?q"}
    assert got == {("a.org/p/q/a.html?old", t) for t in to} | {("a.org/", "a.org/x/z")}


def test_references_resolve_as_a_browser_does(spark):
    from urllib.parse import urljoin

    bases = ["http://h.org/a/b/c?x=/y/#z", "http://h.org", "http://h.org/", "https://h.org/a", "http://h.org?q"]
    tos = ["g", "./g", "g/", "/g", "//g.org/x", "?y", "g?y#s", "../g", "../../g", "../../../g", "/./g/../k", "g/..", "g/.", ".", "..", "http://z.org/a/b?d/../e", "..g", "g..", "x.y/z"]
    pairs = [(b, t) for b in bases for t in tos]
    rows = spark.createDataFrame(pairs, "b string, t string").select("b", "t", urls.node_key(urls.resolve(F.col("b"), F.col("t"))).alias("k")).collect()
    for r in rows:
        host, _, rest = urljoin(r.b, r.t).split("#")[0].split("://", 1)[1].partition("/")
        want = host.replace("?", "/?", 1) if "?" in host else f"{host}/{rest}"
        assert r.k == want, (r.b, r.t)
    more = [("http://h.org/a/b", "c//d", "h.org/a/c//d"), ("http://h.org/a/b", "http://z.org/a/./b/../c", "z.org/a/c")]
    rows = spark.createDataFrame(more, "b string, t string, k string")
    assert rows.where(urls.node_key(urls.resolve(F.col("b"), F.col("t"))) != F.col("k")).count() == 0


def test_one_blocked_target_of_a_redirector_blocks_no_other(spark):
    to = '<meta http-equiv="refresh" content="0; url={}">'.format
    rows = [
        (1, "http://r.org/go?u=1", to("http://foo.net/es/bad")), (2, "http://r.org/go?u=2", to("http://good.org/fine")),
        (3, "http://good.org/fine", ""), (4, "http://r.org/go", ""), (5, "http://foo.net/es/bad", ""),
    ]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(docs.select("page_id", "url"), urls.link_edges(docs)).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block"}


def test_random_link_graphs(spark):
    rng = random.Random(12)
    hosts = ["a{}.org", "b{}.net", "c{}.com", "d{}.net"]
    pages, links = [], []
    for g in range(200):  # each graph has hosts of its own
        mine = sorted({f"http://{rng.choice(hosts).format(g)}/{rng.choice(['es/', 'x/', 'y/', ''])}{rng.randrange(3)}{rng.choice(['', '?a=1', '?a=2', '?'])}" for _ in range(14)})
        shown = [u for u in mine if rng.random() < 0.7]
        out = {u: [rng.choice(mine) for _ in range(rng.choice([0, 0, 1, 1, 2]))] for u in shown}
        links += [(u, v) for u, vs in out.items() for v in vs]
        for u in shown:
            html = "".join(f'<link rel="canonical" href="{v}">' if rng.random() < 0.5 else f'<meta content="1;url={v}" http-equiv="refresh">' for v in out[u])
            pages.append((len(pages), rng.choice(["http", "https"]) + u[4:] + rng.choice(["", "#x"]), html))
    key = lambda u: u.split("://")[1].split("#")[0]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in links:
        root[find(key(u))] = find(key(v))
    seen = {key(u) for _, u, _ in pages} | {key(v) for _, v in links}
    votes = defaultdict(set)
    for k in seen:
        votes[find(k)].add(judged(f"http://{k}")[3])
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(docs.select("page_id", "url"), urls.link_edges(docs)).collect()}
    want = {}
    for i, u, _ in pages:
        said = votes[find(key(u))]
        want[i] = judged(u)[3] or ("block" if "block" in said and "allow" not in said else "allow")
    assert got == want and Counter(want.values())["block"] > 100


def test_rules_reach_targets_that_are_no_pages(spark):
    to = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://a.org/1", to("http://b.net/fr/9")),  # blocked, not crawled
        (2, "http://a.org/2", to("http://b.net/fr/8")), (3, "http://a.org/3", '<meta http-equiv="refresh" content="0; url=http://b.net/fr/8">'),
        (4, "http://c.org/4", to("http://www.example.com/en/4")),  # explicitly allowed, not crawled; the same key without www. is blocked
        (5, "http://c.org/5", to("http://d.org/5")), (6, "http://e.org/6", None),
        (7, "http://c.org/7", to("http://b.net/es/7")), (8, "http://c.org/8", to("http://b.net/es/7")), (9, "http://example.com/en/4", None),
    ]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.via) for r in urls.judge(docs.select("page_id", "url"), urls.link_edges(docs)).collect()}
    assert {i for i, v in got.items() if v == ("block", "alias")} == {1, 2, 3, 7, 8}
    assert got[4] == got[5] == got[6] == ("allow", "default") and got[9] == ("block", "rule")


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 400)] + [(1_000, 1_000 + k) for k in range(1, 200)] + [(rng.randrange(2_000, 2_300), rng.randrange(2_000, 2_300)) for _ in range(150)] + [(5, 5), (None, 3), (401, 400)]
    root = defaultdict(int)
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in edges:
        if a is not None and a != b:
            for x in (a, b):
                root.setdefault(x, x)
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    import sys

    sys.setrecursionlimit(10_000)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: find(i) for i in root}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_many_keys_in_one_text(spark):
    import time

    rng = random.Random(31)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = []
    for i in range(32_000):
        key = "".join(rng.choice(alphabet) for _ in range(24)) + "7x"
        parts.append(f"token={key}" if i % 2 else f"é {key}")
    text = " ".join(parts)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secrets.find(docs.withColumn("text", F.substring("text", 1, 500))).collect()
    start = time.time()
    got = [(s.start, s.kind, s.end) for s in secrets.find(docs).first().spans]
    assert time.time() - start < 60
    assert [s for s in got if s[1] == 0] == spans(text)
    assert sum(s[1] == 3 for s in got) > 15_000 and got == sorted(got)


def test_running_scan(spark):
    rng = random.Random(3)
    rows = [[rng.randrange(-5, 9) for _ in range(n)] for n in (0, 1, 3, 4, 5, 50)]
    docs = spark.createDataFrame([(r,) for r in rows], "v array<bigint>")
    got = docs.select("v", secrets.scan(F.col("v"), lambda a, b: a + b, 0, 4).alias("s"), secrets.scan(F.col("v"), lambda a, b: F.greatest(a, b), 0, 4).alias("m")).collect()
    for r in got:
        assert r.s == [sum(r.v[: i + 1]) for i in range(len(r.v))]
        assert r.m == [max([0, *r.v[: i + 1]]) for i in range(len(r.v))]
