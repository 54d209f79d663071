"""Expected values by hand for rules that SQL twins repeat."""
import pytest

from maskfold.functions import physics
from maskfold.operators import catalogue, confidence, features, metrics, sweep
from maskfold.sources import readers


def test_region_sweep_keeps_empty_maps(spark):
    # a 5 x 5 square at 0.55, a pair at 0.35, in one of three maps; 10 x 20 pixels each
    rows = [(1, "tiled", y, x, 0.55) for y in range(5) for x in range(5)] + [(1, "tiled", 9, x, 0.35) for x in (7, 8)] + [(1, "letterbox", 0, 0, 0.19)]
    px = spark.createDataFrame(rows, "image_id bigint, strategy string, y int, x int, p double")
    maps = spark.createDataFrame([(1, "tiled", 20, 10), (1, "letterbox", 20, 10), (2, "tiled", 20, 10)], "image_id bigint, strategy string, width int, height int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in confidence.region_sweep(px, maps, (0.2, 0.5, 0.6)).collect()}
    assert len(got) == 9
    assert got[1, "tiled", 0.2] == (27, 13.5, 2, 1, 1, 25, 25.0)
    assert got[1, "tiled", 0.5] == (25, 12.5, 1, 1, 1, 25, 25.0)
    for key in ((1, "tiled", 0.6), (1, "letterbox", 0.2), (2, "tiled", 0.2)):
        assert got[key] == (0, 0.0, 0, 0, 0, None, None)


def test_medians_and_macro_means(spark):
    rows = [("m", 10, 0, 0, 90, 10, 10), ("m", 0, 10, 10, 80, 10, 10), ("m", 5, 5, 5, 85, 10, 10), ("m", 0, 0, 0, 100, 0, 0)]
    df = spark.createDataFrame([(*r, 100) for r in rows], "model string, tp long, fp long, fn long, tn long, gt_pixels long, pred_pixels long, total_pixels long")
    r = metrics.micro_macro(metrics.fg_metrics(df), ["model"], two_class=True).first()
    assert (r.median_dice, r.median_precision, r.median_recall) == (0.75, 0.75, 0.75)  # of 1, 0, 0.5 and 1
    assert r.median_iou == pytest.approx((1 + 5 / 15) / 2, abs=1e-6)
    background = [1.0, 160 / 180, 170 / 180, 1.0]
    assert r.macro_mean_dice == pytest.approx(sum((a + b) / 2 for a, b in zip([1, 0, 0.5, 1], background)) / 4, abs=1e-6)


def test_pixel_sweep_medians(spark):
    rows = [(1, 0.9, 1), (1, 0.1, 0), (2, 0.9, 0), (2, 0.1, 1), (3, 0.9, 1), (3, 0.8, 0), (4, 0.1, 0)]
    r = sweep.sweep_pixels(spark.createDataFrame(rows, "image_id long, p double, gt int"), [0.5]).first()
    assert (r.median_dice, r.median_iou) == (0.6667, 0.5)  # of 1, 0 and 2/3; of 1, 0 and 1/2; image 4 has no truth
    assert r.mean_dice == pytest.approx((1 + 2 / 3) / 3, abs=1e-4)


def test_energy_names_the_unit(spark):
    rows = [(None, 5.0, "MJ/m^2/day"), (None, 5.0, "kW-hr/m^2/day"), (None, 5.0, None), (1800.0, 5.0, "MJ/m^2/day"), (None, None, "MJ/m^2/day"), (None, 0.5, "kWh per DAY")]
    df = spark.createDataFrame([(i, *r, 100.0, "calculated", 0.2, 0.75) for i, r in enumerate(rows)], "i int, annual_ghi double, source_daily_ghi double, source_unit string, solar_area_m2 double, physical_area_status string, efficiency double, performance_ratio double")
    got = {r.i: (r.annual_ghi, r.energy_kwh_year, r.energy_reasons) for r in physics.energy(df).collect()}
    assert got[0] == (None, None, ["ghi_unit_incompatible", "ghi_missing"]) == got[2]
    assert got[1] == (1826.25, 27393.75, []) and got[3] == (1800.0, 27000.0, [])
    assert got[4] == (None, None, ["ghi_missing"])
    assert got[5] == (182.62, None, ["ghi_implausible"])  # 182.625 is a tie, rounded to even
    assert "__unit" not in physics.energy(df).columns


def test_review_ids_are_kept(spark):
    rows = [("c", 50, None), ("a", 70, 7), ("b", 60, None), ("d", 90, 2)]
    q = features.review_queue(spark.createDataFrame(rows, "k string, score_pct int, verification_id bigint"), ["k"])
    assert {r.k: (r.verification_id, r.queue_pos) for r in q.collect()} == {"d": (2, 1), "a": (7, 2), "b": (8, 3), "c": (9, 4)}
    q = features.review_queue(spark.createDataFrame([r[:2] for r in rows], "k string, score_pct int"), ["k"])
    assert {r.k: r.verification_id for r in q.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert features.review_queue(spark.createDataFrame([], "k string, score_pct int, verification_id bigint"), ["k"]).count() == 0


def test_one_file_per_id_or_an_error_with_all_files(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "sampleid bigint")
    files = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (9, "z")], "sampleid bigint, filename string")
    with pytest.raises(catalogue.GateError, match="2 ids without exactly one file, such as 2 with 2") as e:
        catalogue.require_one_to_one(ids, files)
    assert e.value.count == 2
    assert sorted(map(tuple, e.value.offenders.collect()), key=str) == [(2, 2, "b"), (2, 2, "c"), (3, 0, None)]
    assert [tuple(r) for r in catalogue.require_one_to_one(ids.where("sampleid = 1"), files).collect()] == [(1, "a")]


def test_world_files_of_a_folder(spark, tmp_path):
    for name in ("a/x.png", "a/x.pgw", "a/y.jpg", "a/y.JGW", "a/z.png", "a/q.tfw", "b/x.png", "b/x_label.bmp", "b/noend"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"0")
    files = readers.list_files(spark, str(tmp_path))
    assert files.count() == 9
    got = {r.folder.rstrip("/").rsplit("/", 1)[1]: tuple(r)[1:] for r in readers.world_file_count(files).collect()}
    assert got == {"a": (3, 3, 2), "b": (1, 0, 0)}
