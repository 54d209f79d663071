import random

import pytest

from maskfold.operators import copies, matching, sweep

DET = "model string, image_id bigint, pred_idx bigint, score_pct int, x0 int, y0 int, x1 int, y1 int, area bigint"
GT = "image_id bigint, gt_idx bigint, x0 int, y0 int, x1 int, y1 int, area bigint"


def box(rng):
    x, y, w, h = rng.randrange(60), rng.randrange(60), rng.randrange(10, 25), rng.randrange(10, 25)
    return x, y, x + w, y + h, w * h


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = w * h if w > 0 and h > 0 else 0
    return inter / (a[4] + b[4] - inter)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    gts = [(i, g, *box(rng)) for i in (1, 2) for g in range(25)]
    dets = []
    for i in (1, 2):
        for p in range(60):
            base = rng.choice([g for g in gts if g[0] == i])[2:]
            dx, dy = rng.randrange(-4, 5), rng.randrange(-4, 5)
            dets.append(("m", i, p, rng.randrange(50, 101), base[0] + dx + 5, base[1] + dy + 5, base[2] + dx + 5, base[3] + dy + 5, base[4]))
    # one object drawn many times over, by prediction and by truth
    dets += [("m", 1, 100 + k, 70, 5, 5, 25, 25, 400) for k in range(40)]
    gts += [(1, 100 + k, 5, 5, 25, 25, 400) for k in range(15)]
    return dets, gts, spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT)


def brute_match(dets, gts, thr=0.5, low=0):
    out = {}
    for i in (1, 2):
        used = set()
        mine = [g for g in gts if g[0] == i]
        for d in sorted((d for d in dets if d[1] == i and d[3] >= low), key=lambda d: (-d[3], d[2])):
            free = [g for g in mine if g[1] not in used]
            if not free:
                continue
            best = min(free, key=lambda g: (-iou(d[4:], g[2:]), g[1]))
            if iou(d[4:], best[2:]) >= thr:
                used.add(best[1])
                out[(i, d[2])] = best[1]
    return out


def got_match(df):
    return {(r.image_id, r.pred_idx): r.gt_idx for r in df.where("gt_idx is not null").collect()}


@pytest.mark.parametrize("limit", [100000, 20, 0])
def test_greedy_matching(spark, data, limit):
    dets, gts, d, g = data
    m = matching.match_greedy(matching.iou_pairs(d, g, cell=16), d, fold_limit=limit)
    assert got_match(m) == brute_match(dets, gts)
    assert m.count() == len(dets)


def test_verdicts_do_not_depend_on_the_threshold(data):
    dets, gts, d, g = data
    full = brute_match(dets, gts)
    for low in (60, 75, 90):
        score = {(x[1], x[2]): x[3] for x in dets}
        assert brute_match(dets, gts, low=low) == {k: v for k, v in full.items() if score[k] >= low}


@pytest.mark.parametrize("limit", [100000, 0])
def test_iou_first(spark, data, limit):
    dets, gts, d, g = data
    want = {}
    for i in (1, 2):
        pairs = sorted((-iou(x[4:], y[2:]), x[2], y[1]) for x in dets for y in gts if x[1] == i and y[0] == i and iou(x[4:], y[2:]) >= 0.5)
        up, ug = set(), set()
        for _, p, q in pairs:
            if p not in up and q not in ug:
                up.add(p), ug.add(q)
                want[(i, p)] = q
    assert got_match(matching.match_iou_first(matching.iou_pairs(d, g), fold_limit=limit)) == want


@pytest.mark.parametrize("limit", [100000, 0])
def test_mask_nms(spark, data, limit):
    dets, _, d, _ = data
    want = set()
    for i in (1, 2):
        kept = []
        for x in sorted((x for x in dets if x[1] == i), key=lambda x: (-x[3], x[2])):
            if all(iou(x[4:], k[4:]) < 0.5 for k in kept):
                kept.append(x)
        want |= {(i, k[2]) for k in kept}
    pairs = matching.iou_pairs(d, d.withColumnRenamed("pred_idx", "other_idx"), "pred_idx", "other_idx", on=("model", "image_id"), extra=(), ordered=True)
    got = matching.mask_nms(d, pairs, 0.5, fold_limit=limit)
    assert {(r.image_id, r.pred_idx) for r in got.collect()} == want


def test_sweep_against_rematching(spark, data):
    dets, gts, d, g = data
    images = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "image_id bigint, has_solar int")
    m = matching.match_greedy(matching.iou_pairs(d, g), d)
    rows = {r.threshold_pct: r for r in sweep.sweep_detections(m, g.where("image_id = 1"), images, [50, 71, 100], ["m"]).collect()}
    for t, r in rows.items():
        hits = {k: v for k, v in brute_match(dets, gts, low=t).items() if k[0] == 1}
        kept = [x for x in dets if x[1] == 1 and x[3] >= t]
        assert (r.tp, r.fp, r.fn) == (len(hits), len(kept) - len(hits), 40 - len(hits))
        assert r.count_mae == abs(len(kept) - 40) / 2
        neg = [x for x in dets if x[1] == 2 and x[3] >= t]
        assert (r.negative_total_predictions, r.negative_fp_images) == (len(neg), int(bool(neg)))


def test_pick_order(spark):
    rows = [("m", 70, 0.8, 5.0, 0.7), ("m", 60, 0.8, 4.0, 0.6), ("m", 65, 0.8, 4.0, 0.7), ("m", 64, 0.8, 4.0, 0.7), ("m", 50, 0.7, 0.0, 0.9)]
    df = spark.createDataFrame(rows, "model string, threshold_pct int, f1 double, negative_fp_rate_percent double, recall double")
    assert sweep.pick_threshold(df).first().threshold_pct == 64


@pytest.mark.parametrize("limit", [20_000, 0])
def test_matching_of_copies(spark, data, limit):
    dets, gts, d, g = data
    assert got_match(copies.match_masks(d, g, pair_limit=limit)) == brute_match(dets, gts)


def test_copies_of_shapes_that_fit_equally_well(spark):
    rng = random.Random(21)
    # two shapes on either side of a prediction with the same IoU, their copies' ids interleaved
    boxes = [(0, 0, 20, 20, 400), (10, 0, 30, 20, 400), (5, 0, 25, 20, 400), (5, 5, 25, 25, 400)]
    ids = rng.sample(range(1_000), 24)
    gts = [(i, k, *rng.choice(boxes[:2])) for i in (1, 2) for k in ids]
    dets = [("m", i, p, rng.choice([60, 70, 80]), *rng.choice(boxes)) for i in (1, 2) for p in range(40)]
    got = copies.match_masks(spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT), 0.3, pair_limit=0)
    assert got_match(got) == brute_match(dets, gts, 0.3)


def test_a_hundred_thousand_copies_in_one_image(spark):
    from pyspark.sql import functions as F

    n = 100_000
    det = spark.range(n).select(F.lit("m").alias("model"), F.lit(1).cast("long").alias("image_id"), F.col("id").alias("pred_idx"), (50 + F.col("id") % 51).cast("int").alias("score_pct"),
        *[F.lit(v).alias(c) for c, v in (("x0", 5), ("y0", 5), ("x1", 25), ("y1", 25))], F.lit(400).cast("long").alias("area"))
    gt = spark.range(n - 10).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("gt_idx"), *[F.lit(v).alias(c) for c, v in (("x0", 6), ("y0", 5), ("x1", 26), ("y1", 25))], F.lit(400).cast("long").alias("area"))
    shapes = copies.shape_pairs(det, gt, copies.fold_shapes(det, ["model", "image_id"], "pred_idx")[1], copies.fold_shapes(gt, ["image_id"], "gt_idx")[1])
    assert [(r.n_pred, r.n_gt, r.inter) for r in shapes.collect()] == [(n, n - 10, 380)]
    got = {r.pred_idx: r.gt_idx for r in copies.match_masks(det, gt).collect()}
    order = sorted(range(n), key=lambda p: (-(50 + p % 51), p))
    assert got == {p: (k if k < n - 10 else None) for k, p in enumerate(order)}


def test_equal_masks_of_several_blocks_are_one_shape(spark):
    rows = [(1, 5, y, y + 2, 0, 4) for y in (0, 4)] + [(1, 3, y, y + 2, 0, 4) for y in (4, 0)] + [(1, 4, 0, 2, 0, 4), (2, 9, 0, 2, 0, 4)]
    members, shapes = copies.fold_shapes(spark.createDataFrame(rows, "image_id bigint, gt_idx bigint, y0 int, y1 int, x0 int, x1 int"), ["image_id"], "gt_idx")
    assert sorted((r.image_id, r.gt_idx, r.shape) for r in members.collect()) == [(1, 3, 3), (1, 4, 4), (1, 5, 3), (2, 9, 9)]
    assert sorted((r.image_id, r.shape, r.n) for r in shapes.collect()) == [(1, 3, 2), (1, 4, 1), (2, 9, 1)]
