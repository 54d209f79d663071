import numpy as np
import pytest
from pyspark.sql import functions as F

from maskfold.operators import features, splits
from maskfold.plans.ordering import exact_percentiles, running


def test_running_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    vals = [5] * 400 + [int(v) for v in rng.integers(0, 50, 800)]
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", v) for i, v in enumerate(vals)], "id bigint, k string, v bigint")
    out = running(df, [F.col("v"), F.col("id")], ["k"], sums={"v": "s"}, maxes={"id": "m"}).collect()
    for k in "ab":
        rows = sorted((r for r in out if r.k == k), key=lambda r: (r.v, r.id))
        assert [r.pos for r in rows] == list(range(1, len(rows) + 1))
        assert [r.s for r in rows] == list(np.cumsum([r.v for r in rows]))
        assert [r.m for r in rows] == list(np.maximum.accumulate([r.id for r in rows]))


def test_exact_percentiles(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0], 50), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, a in groups.items() for v in a], "k string, v double")
    for r in exact_percentiles(df, "v", {"q25": 0.25, "q50": 0.5, "q999": 0.999}, ["k"]).collect():
        want = np.percentile(groups[r.k], [25, 50, 99.9])
        assert np.allclose([r.q25, r.q50, r.q999], want, rtol=0, atol=1e-12)


def test_group_split_is_the_same_in_chunks(spark):
    df = spark.createDataFrame([(i, i * i % 37) for i in range(600)], "image_id bigint, strip bigint")
    one = {(r.strip, r.split) for r in splits.group_split(df, "strip").collect()}
    many = {(r.strip, r.split) for r in splits.group_split(df, "strip", chunk=5).collect()}
    assert one == many and len(one) == len({s for s, _ in one})


def test_group_kfold_keeps_groups_together(spark):
    df = spark.createDataFrame([(i, i % 11, i % 3) for i in range(330)], "cand bigint, image_id bigint, label int")
    rows = splits.stratified_group_kfold(df, "label", "image_id", chunk=4).collect()
    assert len(rows) == 330 and len({(r.image_id, r.fold) for r in rows}) == 11
    assert {r.fold for r in rows} == {0, 1, 2, 3}


def test_group_kfold_against_a_walk(spark):
    import hashlib

    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 25)), int(rng.integers(0, 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "cand bigint, image_id bigint, label int")
    got = {(r.image_id, r.fold) for r in splits.stratified_group_kfold(df, "label", "image_id", chunk=7).collect()}
    per = {}
    for _, g, y in rows:
        per.setdefault(g, [0, 0, 0])[y] += 1
    total = [sum(v[c] for v in per.values()) for c in range(3)]

    def first(g):
        n = per[g]
        return (-round(sum((v - sum(n) / 3) ** 2 for v in n), 6), hashlib.md5(f"42|{g}".encode()).hexdigest(), g)

    folds, want = [[0, 0, 0] for _ in range(4)], set()
    for g in sorted(per, key=first):
        def cost(f):
            share = [[(folds[i][c] + (per[g][c] if i == f else 0)) / total[c] for i in range(4)] for c in range(3)]
            return (round(sum(float(np.std(s)) for s in share) / 3, 12), sum(folds[f]), f)

        f = min(range(4), key=cost)
        want.add((g, f))
        folds[f] = [a + b for a, b in zip(folds[f], per[g])]
    assert got == want


def dealt(position, shares):
    u, at = position % 2**31 * 1_327_217_885 % 2**31, 0.0
    for i, v in enumerate(shares):
        at += v / sum(shares)
        if i == len(shares) - 1 or u < int(2**31 * at):
            return i


def test_many_groups_are_dealt_after_the_largest(spark):
    import hashlib

    rng = np.random.default_rng(12)
    size = [900, 400] + [int(v) for v in rng.integers(1, 6, 3000)]
    df = spark.createDataFrame([(g, n) for g, n in enumerate(size)], "g bigint, n int").select("g", F.explode(F.sequence(F.lit(1), "n")).alias("row"))
    rows = splits.group_split(df, "g", turns=2).groupBy("g", "split").count().collect()
    assert len(rows) == len(size)  # no group in two splits, none lost
    got, total = {r.g: r.split for r in rows}, sum(size)
    names, loads, target = ("train", "val", "test"), [0, 0, 0], [total * r for r in (0.70, 0.15, 0.15)]
    want = {}
    def turn(g):
        return hashlib.md5(f"830|{g}".encode()).hexdigest()

    for g in sorted((0, 1), key=turn):
        p = min(range(3), key=lambda i: (loads[i] / target[i], i))
        loads[p] += size[g]
        want[g] = names[p]
    lack = [max(0.0, t - v) for t, v in zip(target, loads)]
    for i, g in enumerate(sorted(range(2, len(size)), key=lambda g: (size[g], turn(g)))):
        want[g] = names[dealt(i + 1, lack)]
    assert got == want
    held = {s: sum(size[g] for g in got if got[g] == s) for s in names}
    assert all(abs(held[s] - t) < 0.01 * total for s, t in zip(names, target))


def test_dealt_folds_hold_even_class_shares(spark):
    """20,000 groups with one group of a third of all rows, ungrouped rows and a null label."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.floor(F.col("id") / 2)).alias("g"), (F.xxhash64("id") % 3).cast("string").alias("label"))
    df = df.unionAll(spark.createDataFrame([(None, "0"), (None, "1")], "g bigint, label string"))
    folds = splits.stratified_group_kfold(df, "label", "g", k=4, turns=50)
    per = folds.groupBy("g").agg(F.countDistinct("fold").alias("n"), F.count("*").alias("rows")).agg(F.max("n"), F.sum("rows")).first()
    assert per[0] == 1 and per[1] == 60_000
    home = folds.where("g = 7").first().fold
    rows = folds.where("g <> 7").groupBy("label", "fold").count().collect()
    for label in {r.label for r in rows}:
        small = [r["count"] for r in rows if r.label == label and r.fold != home]
        # the three other folds share the rest evenly, the hot group's fold gets next to nothing more
        assert max(small) - min(small) < 0.03 * sum(small)
        assert sum(r["count"] for r in rows if r.label == label and r.fold == home) < 0.12 * sum(small)


def test_folds_by_dealing_alone_and_without_rows(spark):
    df = spark.range(8_000).select(F.floor(F.col("id") / 2).alias("g"), (F.col("id") % 2).cast("int").alias("label"))
    n = {r.fold: r["count"] for r in splits.stratified_group_kfold(df, "label", "g", k=4, turns=0).groupBy("fold").count().collect()}
    assert set(n) == {0, 1, 2, 3} and max(n.values()) - min(n.values()) <= 12
    assert splits.group_split(df.limit(0), "g").count() == 0
    with pytest.raises(splits.GateError):
        splits.stratified_group_kfold(df.limit(0), "label", "g")


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(3)
    y, x = rng.integers(0, 2, 200), rng.integers(0, 20, 200)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, x)], "label int, f int")
    r = features.feature_auc(df, ["f"], [1]).first()
    pos, neg = x[y == 1], x[y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert r.auc == pytest.approx(want, abs=5e-5)


def test_average_precision_small(spark):
    m = spark.createDataFrame([("m", 1, i, s, t) for i, (s, t) in enumerate([(90, 1), (80, 0), (70, 1), (60, 0), (50, 1)])],
                              "model string, image_id bigint, pred_idx bigint, score_pct int, is_tp int")
    gts = spark.range(4)
    assert features.average_precision(m, gts).first().ap == pytest.approx((1 + 2 / 3 + 3 / 5) / 4, abs=1e-6)


def test_scope_deletes_what_is_not_kept(spark):
    from maskfold.plans.materialise import materialise, scope

    with scope(spark):
        gone = materialise(spark.range(3), "gone")
        kept = materialise(gone, "kept", keep=True)
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|no such file"):
        gone.count()
