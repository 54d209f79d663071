import time

import numpy as np
import pandas as pd
import pytest

from maskfold.operators import masks

BLOCK = "image_id bigint, y0 int, y1 int, x0 int, x1 int"


def pixels(spark, arr, image=1):
    ys, xs = np.nonzero(arr)
    return spark.createDataFrame([(image, int(y), int(x)) for y, x in zip(ys, xs)], "image_id bigint, y int, x int")


def flood(arr, connectivity=8):
    seen, comps = np.zeros(arr.shape, bool), []
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (connectivity == 8 or a == 0 or b == 0)]
    for y, x in zip(*np.nonzero(arr)):
        if seen[y, x]:
            continue
        todo, comp = [(y, x)], []
        seen[y, x] = True
        while todo:
            cy, cx = todo.pop()
            comp.append((cy, cx))
            for dy, dx in steps:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < arr.shape[0] and 0 <= nx < arr.shape[1] and arr[ny, nx] and not seen[ny, nx]:
                    seen[ny, nx] = True
                    todo.append((ny, nx))
        ys, xs = [c[0] for c in comp], [c[1] for c in comp]
        comps.append((len(comp), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    return sorted(comps)


def found(regions):
    return sorted((r.area, r.x, r.y, r.width, r.height) for r in regions.collect())


def test_two_regions(spark):
    a = np.zeros((100, 100), bool)
    a[10:20, 10:20] = True
    a[50:53, 50:53] = True
    regions = masks.region_table(masks.label_runs(masks.pixels_to_runs(pixels(spark, a))))
    assert sorted(r.area for r in regions.collect()) == [9, 100]
    images = spark.createDataFrame([(1, 100, 100), (2, 10, 10)], "image_id bigint, width int, height int")
    rows = {r.image_id: r for r in masks.component_stats(regions, images, 20).collect()}
    assert (rows[1].raw_count, rows[1].filtered_count, rows[1].largest_area) == (2, 1, 100)
    assert rows[2].largest_area is None and rows[2].retained_percent == 100.0


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [16, 1024])
def test_components_against_flood(spark, connectivity, tile):
    rng = np.random.default_rng(5)
    a = rng.random((50, 60)) < 0.45
    runs = masks.pixels_to_runs(pixels(spark, a))
    got = masks.region_table(masks.label_runs(runs, connectivity=connectivity, tile=tile))
    assert found(got) == flood(a, connectivity)


def test_snake_across_tiles(spark):
    a = np.zeros((40, 40), bool)
    for y in range(0, 40, 4):
        a[y, :] = True
        if y + 4 < 40:
            a[y : y + 5, 39 if (y // 4) % 2 == 0 else 0] = True
    got = masks.region_table(masks.label_runs(masks.pixels_to_runs(pixels(spark, a)), tile=8))
    assert found(got) == flood(a)


def test_a_hundred_thousand_runs_in_one_tile(spark):
    rng = np.random.default_rng(11)
    a = rng.random((700, 1000)) < 0.4
    a[::7, :500] = True  # long bridges between many small groups
    edge = np.diff(np.pad(a, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (y, x0), (_, x1) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    assert len(y) > 100_000
    runs = spark.createDataFrame(pd.DataFrame({"image_id": 7, "y": y, "x0": x0, "x1": x1}))
    start = time.time()
    got = found(masks.region_table(masks.label_runs(runs)))
    assert time.time() - start < 30
    assert got == flood(a)


def test_runs_that_adjoin_and_chains_of_labels(spark):
    # a spiral, whose arms meet at the end only, and a comb whose teeth join in the last row
    a = np.zeros((61, 61), bool)
    for k in range(0, 30, 4):
        a[k, k:60 - k] = a[60 - k, k:60 - k + 1] = a[k:61 - k, 60 - k] = a[k + 4:61 - k, k] = True
        a[k + 4, k:k + 5] = True
    comb = np.zeros((61, 61), bool)
    comb[:60, ::2] = comb[60, :] = True
    rows = []
    for image, m in ((1, a), (2, comb)):
        rows += [(image, int(y), int(x), int(x) + 1) for y, x in zip(*np.nonzero(m))]  # one run a pixel: neighbours adjoin
    runs = spark.createDataFrame(rows, "image_id bigint, y int, x0 int, x1 int")
    for connectivity in (4, 8):
        got = masks.region_table(masks.label_runs(runs, connectivity=connectivity))
        assert found(got.where("image_id = 1")) == flood(a, connectivity)
        assert found(got.where("image_id = 2")) == flood(comb, connectivity)
    assert masks.label_runs(runs.limit(0)).count() == 0


def test_coverage_and_flatten_with_copies(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for image in (1, 2):
        canvas = np.zeros((200, 200), bool)
        for _ in range(30):
            y, x = rng.integers(0, 150, 2)
            h, w = rng.integers(1, 50, 2)
            canvas[y : y + h, x : x + w] = True
            rows += [(image, int(y), int(y + h), int(x), int(x + w))] * 3
        want[image] = int(canvas.sum())
    df = spark.createDataFrame(rows, BLOCK)
    assert {r.image_id: r.area for r in masks.covered_area(df, ["image_id"]).collect()} == want
    flat = masks.flatten_blocks(df, ["image_id"]).collect()
    for image, n in want.items():
        assert sum(r.x1 - r.x0 for r in flat if r.image_id == image) == n


def test_confusion_case(spark):
    gt = spark.createDataFrame([(1, 0, 2, 0, 5)], BLOCK)
    pred = spark.createDataFrame([("m", 1, 0, 2, 0, 3), ("m", 1, 5, 7, 0, 2)], "model string, " + BLOCK)
    images = spark.createDataFrame([(1, 10, 10), (2, 100, 100)], "image_id bigint, width int, height int")
    rows = {r.image_id: r for r in masks.confusion(gt, pred, images, ["m"]).collect()}
    assert (rows[1].tp, rows[1].fn, rows[1].fp, rows[1].tn) == (6, 4, 4, 86)
    assert (rows[2].tp, rows[2].fn, rows[2].fp, rows[2].tn) == (0, 0, 0, 10000)


def test_component_errors_case(spark):
    gt, pred = np.zeros((60, 60), bool), np.zeros((60, 60), bool)
    gt[5:15, 5:15] = gt[30:40, 30:40] = True
    pred[6:16, 6:16] = pred[45:55, 5:15] = True
    lab = [masks.label_runs(masks.pixels_to_runs(pixels(spark, a))) for a in (gt, pred)]
    images = spark.createDataFrame([(1, 60, 60)], "image_id bigint, width int, height int")
    r = masks.component_errors(*lab, images).first()
    assert (r.gt_components, r.pred_components, r.component_ratio, r.missed, r.false_components) == (2, 2, 1.0, 1, 1)
