"""Fingerprints, fill-in-middle and Merkle manifest against plain Python."""
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from math import exp

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from maskfold.llm import fim, imatch, merkle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x, bits=64):
    return x - (1 << bits) if x >> (bits - 1) else x


def xx(data, seed=42):
    return signed(xxhash.xxh64_intdigest(data, seed))


def murmur(values, seed=42):
    """Spark's 32-bit hash of integers (4 bytes) and longs (low, then high half)."""
    m, rot = 0xFFFFFFFF, lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    for width, v in values:
        h, parts = seed & m, [v & m] if width == 4 else [v & m, v >> 32 & m]
        for k in parts:
            h ^= rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
            h = (rot(h, 13) * 5 + 0xE6546B64) & m
        h ^= width
        for shift, mul in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> shift) * mul & m
        seed = h ^ h >> 16
    return signed(seed, 32)


def _int_hash(v, seed):
    """XXH64 of four bytes with a seed; a further column of a hash is hashed with the hash so far as its seed."""
    return xxhash.xxh64_intdigest(struct.pack("<i", v), seed)


def printed(text, lex, band):
    terms = {xx(w.encode()) for w in WORD.findall(text)}
    kept = terms & lex
    terms = sorted(kept if len(kept) >= band.enough else terms)
    if not terms:
        return []
    out = {murmur([(8, t) for t in terms])}
    for seed in range(1, band.seeds + 1):
        ranks = sorted(_int_hash(seed, xxhash.xxh64_intdigest(struct.pack("<q", t), 42)) >> 1 for t in terms)
        for level in range(64):
            inside = [r for r in ranks if r < 1 << (63 - level)]
            if 1 <= len(inside) <= band.keep:
                out.add(murmur([(4, seed), *[(8, r) for r in inside]]))
    return sorted(out)


def editions(rows):
    """(doc_id, text, next text) in the operator's order: descending id, null last, ties by the hash of the text."""
    def key(r):
        i, t = r
        flag = struct.pack("<i", int(i is None))
        h = signed(xxhash.xxh64_intdigest(flag, xxhash.xxh64_intdigest((t or "").encode(), 42)))
        return i is None, -(i or 0), h

    order = sorted(rows, key=key)
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


def like(a, b):
    return 1.0 if not a and not b else 2 * len(set(a) & set(b)) / (len(a) + len(b))


@pytest.mark.parametrize("limit", [imatch.BROADCAST_TERMS, 0])
def test_fingerprints(spark, monkeypatch, limit):
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", limit)
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(400)], k=rng.randrange(120)))) for i in range(60)]
    rows += [(i, t) for i, t in rows[:5]] * 2 + [(None, "no id " * 3), (None, None), (0, "no id " * 3), (70, None), (71, ""), (72, " \n"), (73, "one"), (74, rows[9][1]), (75, "x" * 9_000 + " y" * 30_000)]
    band = imatch.Band(low=1.0, high=3.5, enough=4, seeds=6)
    df = Counter(xx(w.encode()) for _, t in rows for w in set(WORD.findall(t or "")))
    lex = {t for t, n in df.items() if len(rows) * exp(-band.high) <= n <= len(rows) * exp(-band.low)}
    assert 20 < len(lex) < len(df)
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], "doc_id long, text string, k int, h int, kind int")
    got = imatch.fingerprints(docs, band).collect()
    want = []
    for i, t, after in editions(rows):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, new, nxt = (printed(x, lex, band) for x in (t, edited, after))
        want.append((i, len(t), sha256(edited.encode()).hexdigest(), own, new, like(own, new), like(own, nxt)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert imatch.fingerprints(docs.limit(0)).count() == 0
    one = imatch.fingerprints(docs.where("doc_id = 73")).first()
    assert one.near_next == 1.0 and one.edited == one.own or one.edited_sha256 == sha256(b"ono").hexdigest()


def test_fingerprint_tells_edits_from_strangers(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"t{rng.randrange(3_000)}" for _ in range(rng.randrange(80, 400)))
    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    got = imatch.fingerprints(docs).collect()
    assert sum(r.near_edited > r.near_next for r in got) > 0.97 * len(got)
    assert sum(r.near_next for r in got) / len(got) < 0.06 < 0.12 < sum(r.near_edited for r in got) / len(got)
    strings = docs.limit(3).select(imatch.as_text(F.array(F.lit(-1), F.lit(255)))).first()[0]
    assert strings == "ffffffff000000ff"


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1_000):
        codes = rng.integers(0, 8, n).astype(np.uint8)
        w = fim.Wavelet(codes)
        at = np.arange(n + 1)
        for c in range(8):
            assert w.rank(c, at).tolist() == [int((codes[:p] == c).sum()) for p in at]
        for k in range(1, 5):
            both = np.flatnonzero((codes == 1) | (codes == 2))
            want = int(both[k - 1]) + 1 if len(both) >= k else n
            assert w.find((1, 2), np.array([k]), np.array([0]), np.array([n])).tolist() == [want]


SPLIT = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^.!?\n]*[.!?\n]|[^.!?\n]+", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[^\x20\x09-\x0D]+"}


@pytest.mark.parametrize("unit", list(SPLIT))
def test_fill_in_middle(spark, monkeypatch, unit):
    monkeypatch.setattr("maskfold.llm.arrays.PIECE", 500)
    rng = random.Random(6)
    some = ["".join(rng.choice(["a", "é", "\n", "\U0001f600", ". ", "b! ", "<", "S>", " ", "<S"]) for _ in range(rng.randrange(200))) for _ in range(150)]
    texts = ["", None, "\n", "x", "x\n", "\n\nx", "a<P>b", "<S>", "ab<M>", "<S", "line\n" * 30_000, *some, some[0]]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "null\nkey\n", "", ""), (3, "x", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n string")
    rate, spm = (100, 50) if unit == "line" else (80, 30)
    done = fim.restore(fim.transform(docs, unit=unit, rate=rate, spm=spm)).collect()
    assert len(done) == len(rows)
    want = Counter()
    for i, t, _, _ in rows:
        t = t or ""
        parts = re.findall(SPLIT[unit], t)
        h = [int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
        pre, mid, suf = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
        if not t or any(m in t for m in fim.MARKS) or h[2] % 100 >= rate:
            want[i, len(parts), "plain", None, None, t, t] += 1
        elif h[3] % 100 < spm:
            want[i, len(parts), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", t] += 1
        else:
            want[i, len(parts), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", t] += 1
    assert Counter(tuple(r) for r in done) == want
    assert len({k[2] for k in want}) == 3
    assert fim.transform(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(docs, marks=("<P>", "<S>", ">M<"))


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def grow(level, fan):
    """All levels of a tree above its leaves."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def siblings(levels, place, fan):
    steps = []
    for level in levels[:-1]:
        first = place // fan * fan
        steps.append(("".join(level[first:place]), "".join(level[place + 1 : first + fan])))
        place //= fan
    return steps


@pytest.mark.parametrize(("fan", "levels"), [(2, 10), (2, 2), (3, 2), (5, 1)])
def test_manifest(spark, fan, levels):
    rng = random.Random(fan * 10 + levels)
    rows = [(i, f"text {i} é", rng.choice(["en", "de", None, "Z", "é", ""])) for i in rng.sample(range(5_000), 150)]
    rows += [(6_000, "alone", "one"), *[(7, "same row", "en")] * 3, (None, None, None), (8, "x" * 100_000, "de"), (9, "", "two"), (10, "b", "two"), (7, "tie", "en")]
    docs = spark.createDataFrame([(i, t, g, 5, 6) for i, t, g in rows], "doc_id long, text string, lang string, tree int, proof int")
    leaves = docs.withColumn("leaf", merkle.leaf_digest(F.col("doc_id"), F.col("text"), F.col("lang")))
    got = merkle.manifest(leaves, fan=fan, levels=levels)
    got = got.withColumns({"folded": merkle.fold(F.col("leaf"), F.col("proof")), "said": merkle.proof_digest(F.col("proof"))})

    groups = defaultdict(list)
    for i, t, g in rows:
        groups[g].append((i is not None, i or 0, digest(field(i), field(t), field(g))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: grow([x[2] for x in sorted(groups[g])], fan) for g in names}
    top = grow([trees[g][-1][0] for g in names], fan)
    want = Counter()
    for k, g in enumerate(names):
        for place, (known, i, leaf) in enumerate(sorted(groups[g])):
            proof = siblings(trees[g], place, fan) + siblings(top, k, fan)
            want[i if known else None, leaf, trees[g][-1][0], top[-1][0], tuple(proof), digest(*[x for s in proof for x in s])] += 1
    done = got.collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.proof), r.said) for r in done) == want
    assert all(r.folded == r.root and r.tree == 5 for r in done)
    # a changed leaf, with the siblings of the unchanged one, gives another root
    told = got.select(merkle.fold(F.sha2(F.concat("leaf", F.lit("x")), 256), F.col("proof")).alias("f"), "root")
    assert told.where("f = root").count() == 0
    assert merkle.manifest(leaves.limit(0)).count() == 0


def test_tampered_rows_of_the_query(spark):
    import __spark_entry__ as entry_point

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in entry_point.queries()["op13_merkle_manifest"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert got[r.doc_id].verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or r.n_chars is None)
        assert got[r.doc_id].leaf == digest(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))
