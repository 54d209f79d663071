"""Lists worked out batch by batch in arrays, and tasks whose size does not follow the table."""
from __future__ import annotations

import math
import random
import time

import pytest

from maskfold.operators import catalogue, features, images, masks
from maskfold.plans import fixtures


def _hull(points):
    pts = sorted(set(points))

    def chain(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return _area(chain(pts) + chain(pts[::-1]))


def _area(ps):
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ps, ps[1:] + ps[:1]))) / 2


def _sizes(spark, outlines):
    df = spark.createDataFrame(list(enumerate(outlines)), "i int, vertices array<struct<x:double,y:double>>")
    return {r.i: r for r in features.outline_features(df, ["i"]).collect()}


def test_outlines_against_plain_python(spark):
    rnd = random.Random(3)
    rings = [[(float(rnd.randrange(20)), float(rnd.randrange(20))) for _ in range(rnd.choice([1, 2, 3, 6, 15]))] for _ in range(200)]
    rings += [[(2.0, 2.0)] * 4, [(0.0, 0.0), (1.0, 1.0), (3.0, 3.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
    got = _sizes(spark, rings)
    for i, ps in enumerate(rings):
        area, hull = _area(ps), _hull(ps)
        per = sum(math.dist(p, q) for p, q in zip(ps, ps[1:] + ps[:1]))
        want = (area, per, hull, 4 * math.pi * area / per**2 if per else 0.0, area / hull if hull else 0.0)
        assert tuple(got[i])[1:] == pytest.approx(want, abs=1e-6)


def test_outlines_without_points(spark):
    got = _sizes(spark, [[], None, [(0.0, 0.0), (1.0, None)], [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]])
    assert tuple(got[0]) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert tuple(got[1])[1:4] == tuple(got[2])[1:4] == (None, None, None)
    assert (got[3].outline_area, got[3].hull_area) == (2.0, 2.0)


def test_long_outline_has_its_hull_quickly(spark):
    n = 3_000
    ring = [((100 + (k % 2)) * math.cos(2 * math.pi * k / n), (100 + (k % 2)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    _sizes(spark, [ring[:9]])  # workers and plans are warm
    start = time.time()
    got = _sizes(spark, [ring])[0]
    assert time.time() - start < 5
    assert got.hull_area == pytest.approx(_hull(ring), rel=1e-9)


def test_areas_of_full_images(spark):
    """As many boxes as an image may have in one row, thousands of such rows: in slices, with the areas of the raster."""
    rnd = random.Random(4)

    def some(*keys):
        x, y, w, h = rnd.randrange(60), rnd.randrange(60), rnd.randrange(0, 30), rnd.randrange(0, 30)
        return (*keys, x, y, x + w, y + h, w * h)

    cols = "x0 int, y0 int, x1 int, y1 int, area long"
    g = spark.createDataFrame([some(i, k) for i in range(60) for k in range(i % 41)], "image_id long, gt_idx long, " + cols)
    d = spark.createDataFrame([some("m0", i, k) for i in range(1, 60) for k in range(40 - i % 41)], "model string, image_id long, pred_idx long, " + cols)
    scenes = spark.createDataFrame([(i, 100, 100) for i in range(61)], "image_id long, width int, height int")
    whole = (c.where("x0 < x1 and y0 < y1") for c in (g, d))
    key = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    plan = images.confusion(g, d, scenes, ["m0"])
    assert "aggregate(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert key(plan) == key(masks.confusion(*whole, scenes, ["m0"]))


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 200)
    monkeypatch.setattr(fixtures, "_plans", {})
    monkeypatch.setattr(fixtures, "_sizes", {})
    t = fixtures.Inputs(spark, "/root/testdata/sf0.001")
    lines = t.lineitem.count()
    for view in (t.fx_item, t.fx_gt, t.fx_det):
        assert view.rdd.getNumPartitions() >= lines // 200 > 20


def test_files_are_counted_once(spark):
    files = spark.range(30).selectExpr("id % 10 as sampleid", "concat('f', id % 20) as filename").distinct()
    good, bad = catalogue.join_exactly_one(spark.range(12).withColumnRenamed("id", "sampleid"), files)
    assert all("Exchange" not in f._jdf.queryExecution().executedPlan().toString() for f in (good, bad))
    assert (good.count(), bad.count()) == (0, 12)
