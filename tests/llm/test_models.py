"""Classifier, vector forest, Jaccard join, language models and the pipeline against plain Python."""
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from maskfold.llm import arrays, embed, exchange, jaccard, lmscore, mix, quality

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOC = "doc_id long, text string, n long, f1 string"


class Union(dict):
    def find(self, i):
        self.setdefault(i, i)
        while self[i] != i:
            i = self[i]
        return i

    def join(self, a, b):
        p, q = self.find(a), self.find(b)
        self[max(p, q)] = min(p, q)


def shingle_set(t, k):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def expected(rows, rule):
    sets = [(i, shingle_set(t, rule.words)) for i, t in rows]
    u = Union()
    for k, (i, a) in enumerate(sets):
        u.find(i)
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= rule.percent * len(a | b):
                u.join(i, j)
    return {i: (len(s), u.find(i)) for i, s in sets}


def corpus(seed, n=40, copies=6, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3_000)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    texts = []
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 5, words, words * 3]))
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                if not w:
                    break
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[k].upper(), w[k]]])
            texts.append(" ".join(w) + (f"\n{passage}" if rng.random() < 0.2 else ""))
    texts += ["", None, "  ", "Same Text HERE now", "same text here now", "ONE", "one"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("rule", "limit"), [(jaccard.Rule(3, 90), 10**6), (jaccard.Rule(), 10**6), (jaccard.Rule(3, 90), 300), (jaccard.Rule(2, 70), 200)])
def test_jaccard_join(spark, rule, limit):
    rows = corpus(rule.percent + limit)
    want = expected(rows, rule)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOC)
    got = jaccard.join(docs, rule, limit=limit).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_large_group_in_chunks(spark):
    """One large group of near copies of which every pair is a candidate, with a chunk of a few sets only."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(80)] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    rule = jaccard.Rule(3, 90)
    want = expected(rows, rule)
    assert len({c for _, c in want.values()}) > 5
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOC)
    for limit in (1_500, 10**6):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, rule, limit=limit).collect()} == want


def test_large_candidate_group_is_searched_fast():
    """1,200 near copies of which most link with few others: one task, whose work is in arrays (over 20 s set by set)."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (3, 400)).astype(np.uint64)
    sets = []
    for i in range(1_200):
        s = base[i % 3].copy()
        k = rng.integers(0, 50)
        s[rng.integers(0, 400, k)] = base[(i + 1) % 3][:40][rng.integers(0, 40, k)] if i % 7 == 0 else rng.integers(0, 2**63, k).astype(np.uint64)
        sets.append(np.unique(s))
    rule = jaccard.Rule(3, 90)
    n = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    has = np.zeros((len(sets), code.max() + 1), np.float32)
    has[owner, code] = 1
    over = (has @ has.T).astype(int)
    link = 100 * over >= rule.percent * (n[:, None] + n - over)
    want = np.arange(len(sets))
    while not np.array_equal(new := np.where(link, want, len(sets)).min(axis=1), want):
        want = new
    assert 100 < len(np.unique(want)) < 1_100

    def search(budget, known):
        return jaccard._search(rule)(pa.table({"sid": np.arange(len(sets)), "items": [s.tobytes() for s in sets], "known": pa.array(known, pa.int64()), "budget": [budget] * len(sets)}))

    def joined(edges, label):
        label = label.copy()
        for a, b in edges:
            label[label == label[a]] = label[b]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in np.unique(label)}

    start = time.time()
    t = search(2_000, [None] * len(sets)).to_pylist()
    assert time.time() - start < 10
    edges = [(r["a"], r["b"]) for r in t if not r["pivot"]]
    assert all(link[a, b] for a, b in edges) and len(edges) == len(sets) - len(np.unique(want))
    assert joined(edges, np.arange(len(sets))) == joined([], want)
    assert 0 < sum(n[r["a"]] for r in t if r["pivot"]) < 2_000 + 400
    # what is known to be one component needs no edge
    more = search(10**6, [int(x) if i % 2 else None for i, x in enumerate(want)]).to_pylist()
    label = np.where(np.arange(len(sets)) % 2, want + len(sets), np.arange(len(sets)))
    assert joined([(r["a"], r["b"]) for r in more if not r["pivot"]], label) == joined([], want)


def test_jaccard_repeated_rows_and_null_ids(spark):
    rows = [(3, "a b c d e f g", 1, "x")] * 2 + [(1, "A b c d e f g", 1, "x"), (None, "a b c d e f g", 1, "x"), (None, "q r s t u v", 1, "x"), (9, "", 1, "x"), (None, None, 1, "x")]
    docs = spark.createDataFrame(rows, DOC)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(docs).collect())
    assert got == sorted([("3", 3, "1"), ("3", 3, "1"), ("1", 3, "1"), ("None", 3, "1"), ("None", 2, "None"), ("9", 0, "9"), ("None", 0, "None")])
    kept = sorted((str(r.doc_id), r.text or "") for r in jaccard.keep_one(docs).collect())
    assert kept == sorted([("1", "A b c d e f g"), ("9", ""), ("None", "q r s t u v"), ("None", "")])
    assert jaccard.join(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_kept_each_for_itself(spark):
    rows = [(1, "k l m n o p q r", 1, "x"), (5, "K l m n o p q r", 1, "x"), (5, "u v w x y z z", 1, "x"), (6, "first clean text of six here", 1, "x"), (6, "second and other text of six", 1, "x"), (7, "", 1, "x"), (7, None, 1, "x"), (7, "not blank at all here", 1, "x")]
    got = sorted((r.doc_id, r.text or "") for r in jaccard.keep_one(spark.createDataFrame(rows, DOC)).collect())
    assert got == sorted([(1, rows[0][1]), (5, rows[2][1]), (6, rows[3][1]), (6, rows[4][1]), (7, ""), (7, rows[7][1])])


def test_exchange_counts_and_brings_back():
    rng = np.random.default_rng(4)
    vocabulary = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    batches = [rng.choice(vocabulary, n) for n in (0, 1, 40, 500)]
    total = Counter(np.concatenate(batches).tolist())
    for width in (4, 5, 6):
        layout = exchange.Layout(batches=4, buckets=7, item_bytes=width)
        sent = pa.concat_tables([exchange.send(layout, k, x, np.ones((len(x), 2))) for k, x in enumerate(batches)])
        run = exchange.answer(layout, 2, lambda t: t.astype("<u4"))
        told = pa.concat_tables([run(sent.filter(pc.equal(sent.column("bucket"), b))) for b in range(7)])
        for k, x in enumerate(batches):
            mine = told.filter(pc.equal(told.column("batch"), k))
            _, _, place = layout.ordered(x)
            assert exchange.answers(mine, "<u4", 2)[place].tolist() == [[total[i]] * 2 for i in x.tolist()]


def test_totals_above_32_bits():
    layout = exchange.Layout(batches=3, buckets=1, item_bytes=5)
    items = np.array([7, 99], np.uint64)
    sent = pa.concat_tables([exchange.send(layout, k, items, np.array([[2.0**31, 1.0], [3.0, 2.0]])) for k in range(3)])
    told = exchange.answer(layout, 2, lambda t: t.astype("<u8"))(sent)
    _, _, place = layout.ordered(items)
    for k in range(3):
        got = exchange.answers(told.filter(pc.equal(told.column("batch"), k)), "<u8", 2)[place]
        assert got.tolist() == [[3 * 2**31, 3], [9, 6]]


def test_words_of_a_column_in_pieces(monkeypatch):
    monkeypatch.setattr(arrays, "PIECE", 20)
    texts = ["", None, "a b", " é\tAB \n", "x" * 50 + " y", "a", "\u00a0 z", "b a"]
    found, seen = [], {}
    for p in arrays.pieces(pa.chunked_array([texts[:3], texts[3:]], pa.string()), lower=True):
        for i in range(p.rows):
            a, b = p.bounds[i], p.bounds[i + 1]
            found.append([bytes(p.data[s:e]).decode() for s, e in zip(p.start[a:b], p.end[a:b], strict=True)])
            for w, h in zip(found[-1], p.hash[a:b].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert found == [WORD.findall((t or "").translate(LOWER)) for t in texts] and len(set(seen.values())) == len(seen)
    assert list(arrays.pieces(pa.array([], pa.string()))) == []


def test_divide_skip():
    rng = random.Random(6)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randrange(0, 25))) for _ in range(rng.randrange(1, 12))]
        need = rng.randrange(1, len(lists) + 1)
        c = Counter(x for one in lists for x in one)
        holds = lambda x, places: sum(x in lists[p] for p in places)  # noqa: B023, E731
        assert jaccard.divide_skip(lists, need, holds) == sorted(x for x, k in c.items() if k >= need)


def vectors(seed, groups=40, dims=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 12))):
            out.append((c + rng.normal(size=dims) * rng.choice([0.0, 0.05, 0.1])).tolist())
    return out


@pytest.mark.parametrize("leaf", [400, 30])
def test_vector_forest(spark, leaf):
    rows = vectors(3)
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    every = [(i, v, 0) for i, v in enumerate(rows + bad + rows[:3])]
    df = spark.createDataFrame(every, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embed.near_duplicates(df, leaf=leaf, sample=100).collect()}
    fine = [i for i, v, _ in every if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([every[i][1] for i in fine], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    n = close.sum(1)
    assert len(got) == len(every)
    assert all(got[i].n_links <= k for i, k in zip(fine, n, strict=True))
    assert sum(got[i].n_links for i in fine) >= (0.97 if leaf == 400 else 0.9) * n.sum()
    u = Union()
    for a, b in zip(*np.nonzero(close), strict=True):
        u.join(fine[a], fine[b])
    if leaf == 400:
        assert {i: got[i].component_id for i in fine} == {i: u.find(i) for i in fine}
    for i in set(range(len(every))) - set(fine):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_forest_gets_deeper_with_large_leaves(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(1_500)], "vec_id long, embedding array<double>")
    rows = embed.valid(df, "vec_id", "embedding").selectExpr("id as rep", "1L as n", "dims", "v", "array('0:', '1:') as leaves")
    deep = embed._deepen(rows, 100).selectExpr("rep", "explode(leaves) as leaf")
    sizes = [r["count"] for r in deep.groupBy("leaf").count().collect()]
    assert max(sizes) <= 100 and deep.select("rep").distinct().count() == 1_500


def noisy(rng, n, dims, cosine):
    """Unequal copies of one vector; the cosine of two of them is about `cosine`."""
    c = rng.normal(size=dims)
    return c / np.linalg.norm(c) + rng.normal(size=(n, dims)) * math.sqrt((1 / cosine - 1) / dims)


def test_one_cluster_of_unequal_copies_is_exact(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([noisy(rng, 10_000, 32, 0.95), noisy(rng, 1_200, 32, 0.92), rng.normal(size=(6_000, 32))])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = embed.near_duplicates(df).toPandas().sort_values("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = np.concatenate([(u[a : a + 1000] @ u.T >= 0.9).sum(1) - 1 for a in range(0, len(u), 1000)])
    links = got.n_links.to_numpy()
    assert n.sum() > 5e7 and (links <= n).all() and links.sum() >= 0.999 * n.sum()
    assert got.component_id[n > 4_000].nunique() == 1 and (~got.kept[n > 4_000]).sum() >= (n > 4_000).sum() - 1


def test_dense_leaf_is_not_split(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([noisy(rng, 1_500, 16, 0.95), rng.normal(size=(500, 16))])
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    rows = embed.valid(df, "vec_id", "embedding").selectExpr("id as rep", "1L as n", "dims", "v", "array('0:') as leaves")
    assert {tuple(r.leaves) for r in embed._deepen(rows, 100).collect()} == {("0:=",)}


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels.groupBy("doc_id").agg({"quality": "max"}).withColumnRenamed("max(quality)", "q"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.q for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_classifier_corner_cases(spark):
    docs = spark.createDataFrame([(1, None, 1, ""), (2, "", 1, ""), (None, "a b", 1, ""), (3, "x" * 50_000, 1, ""), (3, "x" * 50_000, 1, "")], DOC)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.classify(docs, none).collect()} == {(0.5, 1)}
    one = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.classify(docs, one).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs.limit(0), one).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 0, 2, 9]), np.array([2.0, 2, 4, 9]))
    assert list(np.diff(y) >= 0) == [True] * (len(y) - 1) and y[-1] == 1.0 and y[0] == 0.25


def scores(rows, target, least):
    toks = [(i, ["<b>", *WORD.findall(t or "")]) for i, t in rows]
    uni, pair, total = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for i, w in toks:
        for m in (0, 1) if i in target else (1,):
            uni[m].update(w)
            pair[m].update(zip(w, w[1:]))
            total[m] += len(w) - 1
    for i, w in toks:
        n, u, p = len(w) - 1, Counter(w), Counter(zip(w, w[1:]))
        loss, k = [0.0, 0.0], 0
        for v, x in zip(w, w[1:]):
            if uni[1][x] < least:
                continue
            k += 1
            q = max(uni[1][x] - u[x], 0.5) / max(total[1] - n, 1)
            for m in (0, 1):
                o = 1 if m == 1 or i in target else 0
                own = (max(uni[m][x] - o * u[x], 0) + lmscore.PRIOR * q) / (max(total[m] - o * n, 1) + lmscore.PRIOR)
                loss[m] -= math.log((max(pair[m][v, x] - o * p[v, x], 0) + lmscore.BACK * own) / (max(uni[m][v] - o * u[v], 0) + lmscore.BACK))
        yield str(i), n, k, *((loss[0] / k, loss[1] / k) if k else (0.0, 0.0))


def test_lm_scores(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("a b c d e f g".split(), [9, 5, 3, 2, 1, 1, 0.2], k=rng.randrange(60)))) for i in range(80)]
    rows += [(5, rows[5][1]), (None, "a b c"), (90, None), (91, " \n "), (92, "zz yy")]
    docs = spark.createDataFrame([(i, t, 1, "") for i, t in rows], DOC)
    target = spark.createDataFrame([(i,) for i in [0, 1, 2, 5, 5, 7, 70, None, 500]], "doc_id long")
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.ce_target, r.ce_background) for r in lmscore.score(docs, target).collect())
    want = sorted(scores(rows, {0, 1, 2, 5, 7, 70}, lmscore.MIN_COUNT))
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b) if a[0] == b[0] else False
    assert lmscore.score(docs.limit(0), target).count() == 0
    assert all(r.score == 0 or r.n_known for r in lmscore.score(docs, target.limit(0)).collect())


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = corpus_pipeline.materialise(docs, name)
        out[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    good = {r.doc_id: r.text for r in out["quality_classifier"].collect()}
    scored = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(good) == {r.doc_id for r in scored.where("score >= 0.5").collect()}
    want = expected(list(good.items()), jaccard.Rule())
    kept = {r.doc_id: r.text for r in out["ngram_jaccard_join"].collect()}
    assert set(kept) == {i for i, (_, c) in want.items() if i == c}
    hidden = {r.doc_id: r.text for r in out["secret_scan"].collect()}
    assert set(hidden) == set(kept) and all(hidden[i] == kept[i] or "[SECRET]" in hidden[i] for i in kept)
    sizes = mix.sample(out["secret_scan"], mix.label_weights(spark.read.parquet(f"{folder}/labels.parquet")))
    words = sum(len(WORD.findall(r.text)) for r in out["mix_sources"].collect())
    assert words == sizes.agg({"taken": "sum"}).first()[0]
    tokens = out["byte_bpe"].collect()
    assert len(tokens) == out["mix_sources"].count() and all(4 * r.n_tokens == len(r.ids) for r in tokens)


def plain_statistics(text):
    """The statistics of a text by loops over its UTF-8 bytes."""
    data = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, size = len(w), max(len(data), 1)
    share = lambda chars: sum(b in chars for b in data) / size
    mean = sum(map(len, w)) / max(n, 1)
    windows = [tuple(w[i : i + 3]) for i in range(n - 2)]
    lines = [x for x in data.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    return {
        "log_words": math.log1p(n), "mean_word": mean, "std_word": math.sqrt(max(sum(len(x) ** 2 for x in w) / max(n, 1) - mean**2, 0)),
        "long_words": sum(len(x) > 14 for x in w) / max(n, 1), "distinct_words": len(set(w)) / n if n else 0.0,
        "repeated_windows": 1 - len(set(windows)) / len(windows) if windows else 0.0, "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "log_line_words": math.log1p(n / len(lines)) if lines else 0.0, "upper": share(range(65, 91)), "digits": share(b"0123456789"), "marks": share(b".,;:'\"()-?"),
        "symbols": share(b"#*$%&|<>"), "end_marks": sum(x[-1] in b".!?" for x in w) / max(n, 1), "other_bytes": share(range(128, 256)),
        "byte_entropy": -sum(c / size * math.log2(c / size) for c in Counter(data).values()) if n else 0.0, "exclaim": share(b"!"),
    }


def test_classifier_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(arrays, "PIECE", 300)
    rng = random.Random(17)
    some = ["".join(rng.choice(["word ", "é! ", "A1 ", "\n", "# ", "same line here\n", "q" * 20 + ". "]) for _ in range(rng.randrange(60))) for _ in range(120)]
    texts = ["", None, " \n ", "\n\n", "x", "a b c a b c", "z " * 20_000, *some]
    docs = spark.createDataFrame([(i, t, 1, "") for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.stats for r in quality.statistics(docs).collect()}
    stats = np.array([[plain_statistics(t)[s] for s in quality.STATS] for t in texts])
    for i in range(len(texts)):
        assert got[i] == pytest.approx(stats[i], abs=1e-9), texts[i]

    label = np.array([float(rng.random() < 0.5) for _ in texts])
    held = np.array([i % 5 == 0 for i in range(len(texts))])
    rows = spark.createDataFrame([(stats[i].tolist(), float(label[i]), bool(held[i])) for i in range(len(texts))], "stats array<double>, label double, held boolean")
    model = quality.train(rows.repartition(7), F.col("held"))
    mean, scale = stats.mean(axis=0), stats.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((stats - mean) / scale, -6, 6)
    draw = np.random.default_rng(quality.SEED)
    waves = draw.normal(size=(len(quality.STATS), quality.FEATURES)) / quality.WIDTH
    phase = draw.uniform(0, 2 * math.pi, quality.FEATURES)
    x = np.array([[*(math.sqrt(2 / quality.FEATURES) * math.cos(sum(a * b for a, b in zip(row, waves[:, j])) + phase[j]) for j in range(quality.FEATURES)), 1.0, *(0.1 * row)] for row in z])
    fit = x[~held]
    ridge = quality.RIDGE * len(fit) / x.shape[1]
    # the same minimum as a least-squares problem with one more row a weight
    weights = np.linalg.lstsq(np.vstack([fit, math.sqrt(ridge) * np.eye(x.shape[1])]), np.concatenate([label[~held], np.zeros(x.shape[1])]), rcond=None)[0]
    assert np.allclose(x @ weights, model.features(stats) @ model.weights, atol=1e-6)
    # calibration: the non-decreasing fit to the labels of the held rows, between knots by lines
    raw = np.rint(np.clip(x @ weights, -0.5, 1.5) * quality.BINS) / quality.BINS
    assert list(np.diff(model.share) >= 0) == [True] * (len(model.share) - 1)
    assert np.interp(raw[held], model.raw, model.share).mean() == pytest.approx(label[held].mean(), abs=0.15)
