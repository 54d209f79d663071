"""Polygons of several rings, image by image and by the joins over the cluster."""
import random

from maskfold.operators import rings
from maskfold.plans.workload import QUERIES

DET = "model string, image_id long, pred_idx long, score_pct int, rings array<array<double>>"
GT = "image_id long, gt_idx long, rings array<array<double>>"


def outline(rng, size=36):
    x, y, w, h = rng.randrange(-4, size), rng.randrange(-4, size), rng.randrange(1, 18), rng.randrange(1, 18)
    if rng.random() < 0.3:
        return [float(v) for v in (x, y, x + w, y + rng.randrange(9), x + rng.randrange(9), y + h)]
    return [float(v) for v in (x, y, x + w, y, x + w, y + h, x, y + h)]


def polygon(rng):
    return rng.choice([None, [], [[1.0, 1.0]]]) if rng.random() < 0.05 else [outline(rng) for _ in range(rng.randrange(1, 4))]


def made(spark, seed):
    rng = random.Random(seed)
    dets = [(f"m{m}", i, k, rng.randrange(50, 56), polygon(rng)) for i in range(14) for m in range(2) for k in range(rng.randrange(0, 8))]
    gts = [(i, k, polygon(rng)) for i in range(1, 15) for k in range(rng.randrange(0, 7))]
    scenes = spark.createDataFrame([(i, 40, 32 if i % 2 else 44) for i in range(13)], "image_id long, width int, height int")
    return spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT), scenes


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_match_is_the_same_by_image_and_by_joins(spark):
    for seed, rules in ((1, ("union", "evenodd")), (2, ("evenodd", "union"))):
        dets, gts, scenes = made(spark, seed)
        got = rows(rings.match(dets, gts, scenes, 0.05, rules=rules))
        assert got == rows(rings.match(dets, gts, scenes, 0.05, rules=rules, limit=0)) == rows(rings.match(dets, gts, scenes, 0.05, rules=rules, limit=9))
        assert len(got) == dets.count() and sum(r[-1] == "1" for r in got) > 5


def test_components_are_the_same_by_image_and_by_raster(spark):
    for rule in ("union", "evenodd"):
        _, gts, scenes = made(spark, 3)
        got = rows(rings.components(gts, scenes, rule))
        assert got == rows(rings.components(gts, scenes, rule, limit=0)) == rows(rings.components(gts, scenes, rule, limit=4)) and len(got) > 20
    assert rows(rings.components(gts.limit(0), scenes)) == []


def test_nothing_is_shuffled_but_the_views(spark):
    """Runs and blocks are not dealt out, sorted by windows or packed into words."""
    for name in ("h8_rings_match", "h8_rings_components"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "x0#" in plan and "bit_or" not in plan
        assert not any("hashpartitioning(" in line and "y" in line.split("hashpartitioning(")[1].split(")")[0].replace("orderkey", "").replace("image_id", "") for line in plan.splitlines())
