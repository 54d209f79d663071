"""Crowded places: counts by pairs of cells against brute force, and towns of many points."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskfold.operators import celltree, features, leakage

DET = "model string, image_id bigint, pred_idx bigint, x0 int, y0 int, x1 int, y1 int"


def boxes(rng, n, wide):
    rows = []
    for i in range(n):
        x, y = rng.randrange(-wide, wide), rng.randrange(-wide, wide)
        rows.append((rng.choice(["m", "n"]), rng.choice([1, 1, 1, 2]), i, x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9)))
    return rows + [(*r[:2], n + k, *r[3:]) for k, r in enumerate(rows[:15])]


@pytest.mark.parametrize("leaf", [30, 4_096])
def test_neighbours_in_a_crowd(spark, monkeypatch, leaf):
    plain = celltree.count_within
    monkeypatch.setattr(features, "count_within", lambda *a: plain(*a, leaf=leaf, levels=5))
    rows = boxes(random.Random(5), 260, 60)
    df = spark.createDataFrame(rows, DET)
    want = {}
    for r in rows:
        c = r[3] + r[5], r[4] + r[6]
        near = [(o[3] + o[5], o[4] + o[6]) for o in rows if o[:2] == r[:2]]
        want[r[2]] = sum(0 < (c[0] - x) ** 2 + (c[1] - y) ** 2 <= 40**2 for x, y in near)
    for crowd in (10_000, 5):
        got = {r.pred_idx: r.neighbour_count for r in features.neighbour_count(df, 20, crowd=crowd).collect()}
        assert got == want


def test_twenty_thousand_centres_in_one_place(spark):
    side = 142  # every half-pixel step of a square is a centre
    n = F.col("id")
    df = spark.range(side * side).select(
        F.lit("m").alias("model"), F.lit(1).cast("long").alias("image_id"), n.alias("pred_idx"),
        F.floor(n / side).cast("int").alias("x0"), (n % side).cast("int").alias("y0"), (F.floor(n / side) + 1).cast("int").alias("x1"), (n % side + 1).cast("int").alias("y1"))
    got = {r.pred_idx: r.neighbour_count for r in features.neighbour_count(df, 100).where("pred_idx % 997 = 0").collect()}
    for i, c in got.items():
        x, y = divmod(i, side)
        want = sum(min(side - 1, y + h) - max(0, y - h) + 1 for d in range(-100, 101) if 0 <= x + d < side for h in [math.isqrt(100 * 100 - d * d)]) - 1
        assert c == want


def metres(a, b):
    (la, lo), (lb, lp) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("home", [(-0.001, -0.001), (62.0, -0.002)])
def test_scene_pairs_of_a_town(spark, monkeypatch, home):
    plain = celltree.count_within
    monkeypatch.setattr(leakage, "count_within", lambda *a: plain(*a, leaf=25, levels=8))
    rng = random.Random(8)
    place = lambda: (home[0] + rng.randrange(4_000) / 1e6, home[1] + rng.randrange(6_000) / 1e6)
    sides = [[place() for _ in range(150)] for _ in range(2)]
    sides[0] += sides[0][:20] + sides[1][:5]
    frames = [spark.createDataFrame([(i, *p) for i, p in enumerate(s)] + [(-1, None, 3.0)], "image_id bigint, latitude double, longitude double") for s in sides]
    got = leakage.near_counts_of(*frames).first().asDict()
    want = Counter()
    for a in sides[0]:
        for b in sides[1]:
            if abs(a[0] - b[0]) <= 0.003 and abs(a[1] - b[1]) <= 0.003:
                for r in leakage.RADII:
                    want[f"within_{r}m"] += metres(a, b) <= r
    assert got == dict(want)
    assert leakage.near_counts(leakage.near_points(*frames)).first().asDict() == got


def test_a_town_of_many_scenes(spark):
    n = 10_000
    side = lambda k: spark.range(n).select("id", (F.lit(21.0) + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000)) / 1e6).alias("latitude"), (F.lit(72.0) + F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1_000)) / 1e6).alias("longitude"))
    got = leakage.near_counts_of(side(1), side(2)).first()
    assert got.within_200m == n * n > got.within_100m > got.within_50m > got.within_20m > 0


def test_scores_in_a_crowd(spark):
    rng = random.Random(44)
    score = lambda: rng.randrange(1_000_000) / 1e6
    current = [(i, p, round(rng.choice([score(), 0.5 + rng.randrange(400) / 1e6]), 6)) for i in (1, 2) for p in range(300)]
    stored = [(i, s, rng.choice([score(), 0.5 + rng.randrange(800) / 2e6, current[s][2], 3.0])) for i in (1, 2, 3) for s in range(120)]
    frames = spark.createDataFrame(stored, "image_id bigint, stored_idx bigint, score double"), spark.createDataFrame(current, "image_id bigint, pred_idx bigint, score double")
    want = {}
    for i, s, v in stored:
        mine = {p: c for j, p, c in current if j == i}
        near = sorted((round(abs(c - v), 9), p) for p, c in mine.items() if round(abs(c - v), 9) <= 0.01)
        if s in mine and abs(mine[s] - v) <= 0.002 + 1e-12:
            want[i, s] = (s, "same_index")
        else:
            want[i, s] = (near[0][1], "closest_score") if near else (None, "unmatched")
    for crowd in (10_000, 3):
        got = {(r.image_id, r.stored_idx): (r.pred_idx, r.how) for r in features.rematch_tolerance(*frames, crowd=crowd).collect()}
        assert got == want
    n = 100_000
    stored = spark.range(n).select(F.lit(1).cast("long").alias("image_id"), (F.col("id") + 10**9).alias("stored_idx"), ((F.col("id") * 7 + 3) / (10.0 * n)).alias("score"))
    current = spark.range(n).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("pred_idx"), (F.col("id") / (1.0 * n)).alias("score"))
    got = features.rematch_tolerance(stored, current)
    assert got.where("how = 'closest_score'").count() == n
    assert got.where(f"abs(pred_idx - ((stored_idx - 1000000000) * 0.7 + 0.3)) > 0.500001").count() == 0
