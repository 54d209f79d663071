import hashlib
import math
import time
import random

import pytest
from pyspark.sql import functions as F

from maskfold.functions import geo, parsing, physics, raster
from maskfold.functions.rounding import half_even
from maskfold.operators import catalogue, confidence, leakage, masks, metrics, splits, tiles
from maskfold.operators.catalogue import GateError


def test_half_even_matches_binary_rounding(spark):
    rng = random.Random(9)
    vals = [rng.uniform(0, 1e5) for _ in range(2000)] + [k / 8 for k in range(200)] + [k / 1000 + 0.005 for k in range(2000)] + [2.675, 0.125, 0.375, -1.5, -2.5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for n in (0, 2, 4, 6):
        for r in df.select("v", half_even("v", n).alias("r")).collect():
            assert r.r == round(r.v, n), (r.v, n)


def test_parse_sample_id(spark):
    names = {"768.0_1.0.png": 768, "0960_1.png": 960, "100.png": 100, "/a/b/12.0_1.0_benchmark.JPG": 12, "x.png": None, "5_0.png": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", parsing.parse_sample_id(F.col("n")).alias("s")).collect()} == names


def test_confidence_bands_and_empty_metrics(spark):
    df = spark.createDataFrame([(v,) for v in (0.95, 0.90, 0.85, 0.70, 0.65)], "v double")
    assert [r[0] for r in df.select(confidence.confidence_band(F.col("v"))).collect()] == ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]
    conf = spark.createDataFrame([(0, 10000, 0, 0), (0, 50, 5, 0)], "tp bigint, tn bigint, fp bigint, fn bigint")
    rows = metrics.fg_metrics(conf).collect()
    assert [rows[0][m] for m in ("dice", "iou", "precision", "recall", "fpr", "fnr")] == [1, 1, 1, 1, 0, 0]
    assert rows[1].recall == 0.0 and metrics.fg_metrics(conf, 1.0).collect()[1].recall == 1.0


def test_letterbox_tiles_and_hann(spark):
    one = spark.range(1)
    p = one.select(raster.letterbox(F.lit(1920), F.lit(1080)).alias("p")).first().p
    assert (p.scaled_w, p.scaled_h, p.pad_top, p.pad_bottom) == (256, 144, 56, 56)
    for dim in (50, 128, 256, 257, 500, 640, 1080, 1920, 3000, 4000):
        starts = one.select(raster.tile_starts(F.lit(dim)).alias("s")).first().s
        assert starts[0] == 0 and starts[-1] == max(0, dim - 256)
        assert all(0 < b - a <= 193 for a, b in zip(starts, starts[1:]))
    w = one.select(raster.hann2d(F.lit(0), F.lit(0), 256, 256).alias("c"), raster.hann2d(F.lit(127), F.lit(128), 256, 256).alias("m")).first()
    assert w.c == pytest.approx(0.001) and w.m == pytest.approx(1.0, abs=1e-3)


def test_energy_and_gsd_cases(spark):
    row = spark.createDataFrame([(250.0, "calculated", 2000.0, 0.20, 0.75, 0.716), (None, "insufficient_data", 2000.0, 0.2, 0.75, 0.716), (250.0, "calculated", 2000.0, None, 0.75, None)],
                                "solar_area_m2 double, physical_area_status string, annual_ghi double, efficiency double, performance_ratio double, emission_factor double")
    out = physics.co2(physics.energy(row)).collect()
    assert out[0].energy_kwh_year == 75000.0 and out[0].co2_kg_year == 53700.0 and out[0].co2_tonnes_year == 53.7
    assert out[1].energy_kwh_year is None and out[1].energy_reasons == ["area_unavailable"] and out[1].co2_reasons[0] == "energy_unavailable"
    assert out[2].energy_reasons == ["efficiency_missing"] and "emission_factor_missing" in out[2].co2_reasons
    tags = spark.createDataFrame(
        [(1, [0.5, 0.5, 0.0], [0.0, 0.0, 0.0, 500000.0, 2000000.0, 0.0], "projected", "metre"), (2, [1e-5, 1e-5, 0.0], [0.0, 0.0, 0.0, 72.83, 21.17, 0.0], "geographic", "degree"),
         (3, [0.5, 0.5, 0.0], [0.0] * 6, None, "unknown")],
        "image_id bigint, scale array<double>, tiepoint array<double>, crs_kind string, map_units string").withColumns(
        {"matrix": F.lit(None).cast("array<double>"), "width": F.lit(100), "height": F.lit(100)})
    g = {r.image_id: r for r in geo.gsd_from_affine(geo.affine_from_tags(tags)).collect()}
    assert (g[1].gsd_x, g[1].geo_pixel_area_m2, g[1].gsd_status) == (0.5, 0.25, "VALIDATED")
    assert g[2].gsd_x == pytest.approx(1.0385, rel=1e-3) and g[2].gsd_y == pytest.approx(1.1072, rel=1e-3)
    assert g[3].gsd_x is None and g[3].gsd_status == "INSUFFICIENT_DATA"


def test_bad_inputs_raise(spark):
    with pytest.raises(Exception, match="impossible pixel counts"):
        physics.physical_area(spark.createDataFrame([(9, 4, 0.25, None, None, None)], "solar_pixels bigint, total_pixels bigint, cal_pixel_area_m2 double, cal_gsd double, cal_gsd_x double, cal_gsd_y double")).collect()
    with pytest.raises(Exception, match="not binary"):
        catalogue.normalise_mask(spark.createDataFrame([(1, 0), (1, 7)], "image_id bigint, v int")).collect()
    with pytest.raises(GateError):
        catalogue.require_columns(spark.range(1), ["id", "x"])
    with pytest.raises(GateError):
        names = spark.createDataFrame([("a",)], "filename string")
        splits.assert_no_leak(names, names, names)


def test_fingerprint_plain_and_tree(spark):
    names = [f"f{i}.png" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names + names[:50]], "filename string")
    plain = hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()
    assert splits.set_fingerprint(df, "filename", depth=0).first().fingerprint == plain
    tree = {tuple(splits.set_fingerprint(df.repartition(n), "filename").first()) for n in (1, 7)}
    assert len(tree) == 1 and plain not in tree and tree.pop()[1] == "tree-3"


def test_fingerprint_of_a_split_does_not_depend_on_other_splits(spark):
    few = [("test", f"t{i}") for i in range(20)]
    many = [("train", f"r{i}") for i in range(5_000)]
    alone, beside = ({r.split: r.fingerprint for r in splits.set_fingerprint(spark.createDataFrame(x, "split string, f string"), "f", ["split"]).collect()} for x in (few, few + many))
    assert alone["test"] == beside["test"]


def test_fraction_cuts(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "image_id bigint")
    n = {r.split: r["count"] for r in splits.fraction_split(df, "image_id").groupBy("split").count().collect()}
    assert n == {"train": 3, "test": 2}  # int(3.5), int(0.75), the rest


def test_absent_iscrowd_is_kept(spark):
    rows = [(1, 2.0, None, [[0.0] * 6]), (2, 2.0, 1, [[0.0] * 6]), (3, 0.0, 0, [[0.0] * 6]), (4, 2.0, 0, [[0.0] * 4])]
    ann = spark.createDataFrame(rows, "id bigint, area double, iscrowd int, segmentation array<array<double>>")
    assert [r.id for r in catalogue.valid_annotations(ann).collect()] == [1]


def test_gate_names_all_offenders(spark):
    with pytest.raises(GateError) as e:
        catalogue.must_be_empty(spark.range(50), "too many")
    assert e.value.count == 50 and e.value.offenders.count() == 50 and "50 rows" in str(e.value)


def test_coverage_rounds_ties_to_even(spark):
    images = spark.createDataFrame([(1, 640, 640), (2, 640, 640), (3, 640, 640)], "image_id bigint, width int, height int")
    area = spark.createDataFrame([(1, 128), (2, 384)], "image_id bigint, area bigint")
    got = {r.image_id: r.coverage_percent for r in masks.coverage(area, images).collect()}
    assert got == {1: 0.0312, 2: 0.0938, 3: 0.0}  # 0.03125 and 0.09375


def test_maps_are_judged_one_by_one(spark):
    px = spark.createDataFrame([(1, 0.25, 0.75), (2, 0.5, 0.9)], "image_id bigint, p_bg double, p double")
    got = confidence.prob_validate(px)
    assert {r.image_id: r.valid for r in got.collect()} == {1: 1, 2: 0}
    with pytest.raises(GateError, match="1 rows"):
        confidence.require_valid(got)


def test_locked_split_gates(spark):
    rows = [(i, int(i < 80), None if i < 5 else int(i >= 10)) for i in range(100)]
    df = spark.createDataFrame(rows, "image_id bigint, has_solar int, annotation_count int")
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "image_id bigint")
    n = {(r.split, r.dataset_type): r["count"] for r in splits.locked_split(df, ids(20, 21), "image_id", 8, (10, 5)).groupBy("split", "dataset_type").count().collect()}
    assert n[("excluded", "positive_unannotated")] == 5 and n[("excluded", "zero_annotation")] == 5 and n[("test", "positive_annotated")] == 2
    for protected, sizes, expected, match in ((ids(3), (10, 5), None, "protected"), (ids(7), (10, 5), None, "protected"), (ids(20), (20, 5), None, "negatives"), (ids(20), (10, 5), {"negative": 19}, "sizes")):
        with pytest.raises(GateError, match=match):
            splits.locked_split(df, protected, "image_id", 8, sizes, expected=expected)


def test_largest_regions_of_each_image(spark):
    rows = [(i, k, 10 + k) for i in (1, 2) for k in range(40)]
    top = masks.largest_regions(spark.createDataFrame(rows, "image_id bigint, label bigint, area bigint")).collect()
    assert sorted((r.image_id, r.label) for r in top) == [(i, k) for i in (1, 2) for k in range(25, 40)]


def test_custom_scenario_holds_what_is_given(spark):
    from maskfold.functions import physics

    one = lambda *a: {r.x.scenario: r.x for r in spark.range(1).select(F.explode(physics.scenarios(*a)).alias("x")).collect()}["custom"]
    assert (one().efficiency, one().performance_ratio, one().emission_factor) == (None, None, None)
    assert one(0.2, 0.8, 0.7).emission_factor == 0.7


def test_median_fill_takes_the_middle_of_two(spark):
    from maskfold.functions.parsing import fill_median

    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 5.0), (4, 9.0), (5, None)], "k int, v double")
    assert {r.k: r.v for r in fill_median(df, ["v"]).collect()}[5] == 3.5


def test_split_sizes(spark):
    df = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 50 > 1)) for i in range(1000)], "image_id bigint, has_solar int, annotation_count int")
    test = df.where("has_solar = 1 and annotation_count > 0").limit(80)
    rows = splits.locked_split(df, test, "image_id", 60, (100, 50)).collect()
    n = {}
    for r in rows:
        n[(r.split, r.dataset_type)] = n.get((r.split, r.dataset_type), 0) + 1
    assert len(rows) == 1000 and n[("test", "positive_annotated")] == 80 and n[("val", "positive_annotated")] == 60
    assert (n[("train", "negative")], n[("val", "negative")], n[("test", "negative")]) == (100, 50, 100)


@pytest.mark.parametrize("limit", [100000, 0])
def test_hamming_pairs(spark, limit):
    rng = random.Random(7)
    base = [rng.getrandbits(63) - rng.getrandbits(1) * 2**63 for _ in range(30)]

    def near(h):
        for _ in range(rng.randrange(6)):
            h ^= 1 << rng.randrange(63)
        return h

    a, b = [near(h) for h in base * 3] + [base[0]] * 200, [near(h) for h in base * 3] + [base[0]] * 200
    frames = [spark.createDataFrame([(i, h) for i, h in enumerate(x)], "image_id bigint, hash bigint") for x in (a, b)]
    got = {(r.a_hash, r.b_hash): (r.hamming, r.a_rows * r.b_rows) for r in leakage.hamming_pairs(*frames, bucket_limit=limit).collect()}
    want = {}
    for x in set(a):
        for y in set(b):
            d = ((x ^ y) & (2**64 - 1)).bit_count()
            if d <= 3:
                want[(x, y)] = (d, a.count(x) * b.count(y))
    assert got == want


def test_polygons_against_point_in_polygon(spark):
    rings = {1: [10, 2, 30, 20, 12, 33, 2, 15], 2: [5, 5, 35, 5, 35, 30, 20, 12, 5, 30], 3: [3, 3, 30, 30, 30, 3, 3, 30], 4: [-10, -10, 20, 5, 5, 60]}
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in rings.items()], "image_id bigint, ring array<double>")
    images = spark.createDataFrame([(k, 40, 40) for k in rings], "image_id bigint, width int, height int")
    got = {k: set() for k in rings}
    for r in tiles.polygon_to_runs(df, images, ["image_id"]).collect():
        got[r.image_id] |= {(r.y, x) for x in range(r.x0, r.x1)}
    for k, ring in rings.items():
        pts = list(zip(ring[::2], ring[1::2]))
        want = set()
        for y in range(40):
            for x in range(40):
                inside = False
                for (xa, ya), (xb, yb) in zip(pts, pts[1:] + pts[:1]):
                    if (ya <= y + 0.5) != (yb <= y + 0.5) and x + 0.5 >= xa + (y + 0.5 - ya) * (xb - xa) / (yb - ya):
                        inside = not inside
                if inside:
                    want.add((y, x))
        if k != 3:
            assert got[k] == want, k
        else:  # edges that cross inside a band: allow the two pixels at the crossing
            assert len(got[k] ^ want) <= 2


def inside(ring, x, y):
    pts, hit = list(zip(ring[::2], ring[1::2])), False
    for (xa, ya), (xb, yb) in zip(pts, pts[1:] + pts[:1]):
        if (ya <= y) != (yb <= y) and x >= xa + (y - ya) * (xb - xa) / (yb - ya):
            hit = not hit
    return hit


@pytest.mark.parametrize("rule", ["union", "evenodd"])
@pytest.mark.parametrize("load", [2_000_000, 50])
def test_polygons_of_several_rings(spark, monkeypatch, rule, load):
    monkeypatch.setattr(tiles, "CROSSINGS", load)
    rng = random.Random(13)
    ring = lambda: [rng.choice([rng.uniform(-8, 48), float(rng.randrange(40))]) for _ in range(2 * rng.randrange(3, 9))]
    polygons = {i: [ring() for _ in range(rng.randrange(1, 5))] for i in range(40)}
    polygons |= {50: [], 51: None, 52: [[1.0, 1.0, 5.0, 5.0]], 53: [None, [0.0, 0.0, 9.0, 0.0, 9.0, 9.0, 0.0, 9.0, 7.0]], 54: [[0.0, 0.0, None, 0.0, 9.0, 9.0]], 55: [[3.0, 3.0, 3.0, 3.0, 3.0, 3.0]]}
    df = spark.createDataFrame([(1, k, r) for k, r in polygons.items()] + [(2, 99, [[0.0, 0.0, 9.0, 0.0, 9.0, 9.0]]), (None, 98, [])], "image_id bigint, id bigint, rings array<array<double>>")
    images = spark.createDataFrame([(1, 40, 30), (3, None, 4)], "image_id bigint, width int, height int")
    got = {k: set() for k in polygons}
    for r in tiles.rings_to_runs(df, images, ["image_id", "id"], rule).collect():
        new = {(r.y, x) for x in range(r.x0, r.x1)}
        assert new and not new & got[r.id]
        got[r.id] |= new
    for k, rings in polygons.items():
        good = [r[: len(r) // 2 * 2] for r in rings or [] if r and len(r) >= 6 and None not in r]
        hits = {(y, x): sum(inside(r, x + 0.5, y + 0.5) for r in good) for y in range(30) for x in range(40)}
        assert got[k] == {p for p, n in hits.items() if (n > 0 if rule == "union" else n % 2)}, k
    assert tiles.rings_to_runs(df.limit(0), images, ["id"], rule).count() == 0


def test_long_outline_is_filled_quickly(spark):
    n, size = 10_000, 4_000
    ring = [v for k in range(n) for a in (2 * math.pi * k / n,) for r in (1_500 + 300 * math.sin(40 * a),) for v in (2_000 + r * math.cos(a), 2_000 + r * math.sin(a))]
    df = spark.createDataFrame([(1, [ring])], "image_id bigint, rings array<array<double>>")
    images = spark.createDataFrame([(1, size, size)], "image_id bigint, width int, height int")
    run = lambda: tiles.rings_to_runs(df, images, ["image_id"]).selectExpr("sum(x1 - x0)").first()[0]
    run()  # workers and plans are warm
    start = time.time()
    got = run()
    assert time.time() - start < 5
    area = sum(ring[i] * ring[(i + 3) % (2 * n)] - ring[(i + 2) % (2 * n)] * ring[i + 1] for i in range(0, 2 * n, 2)) / 2
    assert got == pytest.approx(area, rel=1e-4)


def test_haversine(spark):
    d = spark.range(1).select(geo.haversine(F.lit(21.17), F.lit(72.83), F.lit(21.18), F.lit(72.83)).alias("d")).first().d
    assert d == pytest.approx(6371000 * math.radians(0.01), rel=1e-9)
