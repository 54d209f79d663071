"""Work inside one image gives the rows of the joins by cell, whatever the image holds."""
from __future__ import annotations

import random

import pytest

from maskfold.operators import features, images, masks, matching

MODELS = ("m0", "m1")


@pytest.fixture(scope="module")
def boxes(spark):
    rnd = random.Random(5)

    def box():
        x, y, w, h = rnd.randrange(300), rnd.randrange(300), rnd.randrange(5, 60), rnd.randrange(5, 60)
        return x, y, x + w, y + h, w * h

    gts = [(i, 10 * k, *box()) for i in range(12) for k in range(i)]
    dets = []
    for i in range(13):
        for m in MODELS:
            for k in range(i):
                if rnd.random() < 0.7 and 0 < i < 12:  # a copy, shifted a little
                    x0, y0, x1, y1, _ = gts[sum(range(i)) + rnd.randrange(i)][2:]
                    s = rnd.randrange(4)
                    b = (x0 + s, y0, x1 + s, y1, (x1 - x0) * (y1 - y0))
                else:
                    b = box()
                dets.append((m, i, 7 * k, rnd.randrange(50, 54), *b))
    cols = "x0 int, y0 int, x1 int, y1 int, area long"
    d = spark.createDataFrame(dets, "model string, image_id long, pred_idx long, score_pct int, " + cols)
    return d, spark.createDataFrame(gts, "image_id long, gt_idx long, " + cols)


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, map(tuple, df.select(*cols).collect())))


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_images_are_the_joins(boxes, limit):
    d, g = boxes
    pairs = matching.iou_pairs(d, g)
    m = matching.match_greedy(pairs, d, 0.5)
    assert rows(images.match(d, g, limit=limit)) == rows(m)
    assert rows(images.details(d, g, limit=limit)) == rows(matching.match_details(m, pairs))
    assert rows(images.match_iou_first(d, g, limit=limit)) == rows(matching.match_iou_first(pairs))
    assert rows(images.missed_gt(d, g, MODELS, limit=limit)) == rows(matching.missed_gt(g, m, MODELS))
    selfp = images.self_pairs(d)
    assert rows(images.mask_nms(d, 0.3, limit=limit)) == rows(matching.mask_nms(d, selfp, 0.3))
    plain = matching.max_iou_any(m.where("is_tp = 0"), pairs, matching.both_ways(selfp), m.where("is_tp = 1"))
    assert rows(images.max_iou_any(d, g, limit=limit)) == rows(plain.drop("gt_idx", "iou", "is_tp"))


def test_masks_are_shuffled_once(spark, boxes):
    d, g = boxes
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = images.match(d.repartition("image_id"), g.repartition("image_id")).groupBy("model", "image_id").count()
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", [3, 1000])
def test_areas_are_those_of_the_raster(spark, boxes, limit):
    d, g = boxes
    scenes = spark.createDataFrame([(i, 400, 400) for i in range(15)], "image_id long, width int, height int")
    assert rows(images.covered_area(g, limit)) == rows(masks.covered_area(g, ["image_id"]))
    assert rows(images.confusion(g, d, scenes, MODELS, limit)) == rows(masks.confusion(g, d, scenes, MODELS))


@pytest.mark.parametrize("limit", [3, 1000])
def test_neighbours_are_those_of_the_cells(boxes, limit):
    d, _ = boxes
    assert rows(images.neighbour_count(d, 40, limit)) == rows(features.neighbour_count(d, 40).select("model", "image_id", "pred_idx", "neighbour_count"))
    d = d.selectExpr("*", "score_pct / 100 as score")
    s, c = d.where("model = 'm0'").withColumnRenamed("pred_idx", "stored_idx"), d.where("model = 'm1'")
    assert rows(images.rematch_nearest(s, c, limit)) == rows(features.rematch_nearest(s, c))


@pytest.mark.parametrize("accuracy", [10_000, 2])
def test_percentiles_order_only_what_is_near(spark, monkeypatch, accuracy):
    import numpy as np
    from pyspark.sql import functions as F

    from maskfold.plans import ordering

    sent = []
    plain = ordering.running
    monkeypatch.setattr(ordering, "running", lambda df, *a, **k: sent.append(df.count()) or plain(df, *a, **k))
    monkeypatch.setattr(ordering, "ACCURACY", accuracy)
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.xxhash64("id") / 1e12).alias("v"))
    got = {r.g: (r.a, r.b) for r in ordering.exact_percentiles(df, "v", {"a": 0.25, "b": 0.9}, ["g"]).collect()}
    for g in (0, 1):
        v = [r.v for r in df.where(F.col("g") == g).collect()]
        assert got[g] == pytest.approx(tuple(np.percentile(v, [25, 90])), rel=1e-12)
    if accuracy > 2:
        assert sent[0] < 1_000


def test_curve_is_counted_while_it_is_ordered(spark):
    from pyspark.sql import functions as F

    from maskfold.plans import ordering

    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"), (F.hash("id") % 50).alias("s"), (F.hash("id", "id") % 2 == 0).cast("long").alias("hit"))
    order = [-F.col("s"), F.col("i")]
    cum = ordering.tally(df, order, "hit", ["g"]).withColumn("p", F.col("tp_cum") / F.col("rank"))
    assert cum._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning") == 0
    got = {(r.g, r.i): (r["rank"], r.tp_cum, r.env) for r in ordering.from_end(cum, "p", "env", ["g"]).collect()}
    rows = sorted(df.collect(), key=lambda r: (r.g, -r.s, r.i))
    for g in range(3):
        mine, hits, want = [r for r in rows if r.g == g], 0, []
        for n, r in enumerate(mine, 1):
            hits += r.hit
            want.append((n, hits, hits / n))
        top = 0.0
        for r, (n, h, p) in reversed(list(zip(mine, want))):
            top = max(top, p)
            assert got[g, r.i] == (n, h, top)
