import json
import uuid

import pytest

from maskfold.sources import history, readers, sinks
from maskfold.sources.schemas import HISTORY
from maskfold.streaming.history_stream import stream_history


def test_stream_keeps_latest_and_rejects_bad_ids(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    ids = [str(uuid.uuid4()) for _ in range(3)]

    def land(name, rows):
        (landing / name).write_text("\n".join(json.dumps(r) for r in rows))

    args = (spark, str(landing), str(tmp_path / "log"), str(tmp_path / "cp"))
    land("a.json", [{"prediction_id": i, "status": "first", "persisted_at_utc": "2025-01-01T00:00:00.000001+00:00"} for i in ids] + [{"prediction_id": "nope"}])
    stream_history(*args).awaitTermination()
    land("b.json", [{"prediction_id": ids[0], "status": "second", "persisted_at_utc": "2025-01-01T00:00:00.000002+00:00"},
                    {"prediction_id": ids[1], "op": "delete", "persisted_at_utc": "2025-01-02T00:00:00+00:00"}])
    stream_history(*args).awaitTermination()
    log = spark.read.schema(HISTORY).option("recursiveFileLookup", True).parquet(str(tmp_path / "log"))
    assert {r.prediction_id: r.status for r in history.history_current(log).collect()} == {ids[0]: "second", ids[2]: "first"}


def test_a_new_checkpoint_keeps_the_old_log(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    ids = [str(uuid.uuid4()) for _ in range(3)]
    for n, some in (("a", ids[:2]), ("b", ids[2:])):
        (tmp_path / "landing" / f"{n}.json").write_text("\n".join(json.dumps({"prediction_id": i}) for i in some))
        stream_history(spark, str(tmp_path / "landing"), str(tmp_path / "log"), str(tmp_path / f"cp{n}")).awaitTermination()
    log = spark.read.schema(HISTORY).option("recursiveFileLookup", True).parquet(str(tmp_path / "log"))
    assert log.count() == 5 and {r.prediction_id for r in history.history_current(log).collect()} == set(ids)


def test_what_arrives_last_counts(spark, tmp_path):
    path = str(tmp_path / "log")
    at = lambda day, v: spark.sql(f"select 'a' as prediction_id, timestamp'2025-01-{day} 00:00:00' as persisted_at_utc, {v} as v")
    history.history_upsert(at("05", 1), path)
    history.history_upsert(at("01", 2), path)  # back-dated
    assert history.history_current(spark.read.parquet(path)).first().v == 2
    history.history_delete(spark.read.parquet(path), spark.createDataFrame([("a",)], "prediction_id string"), path)
    assert history.history_current(spark.read.option("mergeSchema", True).parquet(path)).count() == 0


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "c.csv").write_text("sampleid,longitude,latitude,has_solar\n1,75.5,20.25,1\n")
    (tmp_path / "m.csv").write_text("filename,note,sampleid\na.png,x,1\n")
    r = readers.scan_catalogue(spark, str(tmp_path / "c.csv"), str(tmp_path / "m.csv")).first()
    assert (r.sampleid, r.filename, r.latitude, r.longitude) == (1, "a.png", 20.25, 75.5)
    (tmp_path / "bad.csv").write_text("sampleid,filename\none,a.png\n")
    with pytest.raises(Exception, match="sampleid is not bigint"):
        readers.scan_metrics(spark, str(tmp_path / "bad.csv"), "sampleid bigint, filename string").collect()
    with pytest.raises(ValueError, match="missing columns"):
        readers.scan_metrics(spark, str(tmp_path / "bad.csv"), "sampleid bigint, score double")


def test_report_layout_is_the_same_at_every_size(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id bigint")
    regions = spark.createDataFrame([(1, k, 5) for k in range(7)] + [(2, 0, 5)], "image_id bigint, label bigint, area bigint")
    got = sorted((r.image_id, r.part, r.parts, len(r.regions)) for r in sinks.report_rows(images, regions, chunk=3).collect())
    assert got == [(1, 0, 3, 3), (1, 1, 3, 3), (1, 2, 3, 1), (2, 0, 1, 1), (3, 0, 1, 0)]


def test_upsert_delete_and_paging(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"id{i:02d}", f"2025-01-01 00:00:{i:02d}") for i in range(15)]
    df = spark.createDataFrame(rows, "prediction_id string, t string").selectExpr("prediction_id", "cast(t as timestamp) as created_at_utc")
    history.history_upsert(df.unionAll(df.selectExpr("''", "created_at_utc")), path)
    cur = history.history_current(spark.read.parquet(path))
    assert cur.count() == 15
    page = history.page_newest(cur, 5, 5).collect()
    assert [r.prediction_id for r in page] == [f"id{i:02d}" for i in (9, 8, 7, 6, 5)]
    assert history.page_newest(cur, -3, 1000).count() == 15
    gone = history.history_delete(spark.read.parquet(path), spark.createDataFrame([("id03",), ("zz",)], "prediction_id string"), None)
    assert {r.prediction_id: r.deleted for r in gone.collect()} == {"id03": 1, "zz": 0}


def test_inventory_coco_and_split_ids(spark, tmp_path):
    for n in ("PV01_1_1.bmp", "PV01_1_1_label.bmp", "PV01_2_1.bmp"):
        (tmp_path / n).write_bytes(b"x")
    paired, missing = readers.file_inventory(spark, str(tmp_path))
    assert paired.count() == 1 and missing.first().path.endswith("PV01_2_1.bmp")
    coco = {"images": [{"id": 1, "file_name": "a/b.png", "width": 4, "height": 5}],
            "annotations": [{"id": 1, "image_id": 1, "area": 2.0, "iscrowd": 0, "segmentation": [[0, 0, 2, 0, 2, 2]]},
                            {"id": 2, "image_id": 1, "area": 2.0, "iscrowd": 0, "segmentation": {"size": [5, 4], "counts": "abc"}}]}
    (tmp_path / "c.json").write_text(json.dumps(coco, indent=1))
    images, polygons, coded = readers.scan_coco(spark, str(tmp_path / "c.json"))
    assert images.first().file_name == "b.png" and polygons.first().segmentation == [[0.0, 0.0, 2.0, 0.0, 2.0, 2.0]] and coded.first().segmentation_rle.counts == "abc"
    (tmp_path / "s.json").write_text(json.dumps({"train": [1, 2], "test": [3]}))
    assert {(r.split, r.image_id) for r in readers.scan_split_ids(spark, str(tmp_path / "s.json")).collect()} == {("train", 1), ("train", 2), ("test", 3)}


def test_repeated_sampleid_is_an_error(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, 20.0, 75.0, 1), (1, 21.0, 75.0, 1)], "sampleid bigint, latitude double, longitude double, has_solar int"), str(tmp_path / "c"))
    sinks.write_csv(spark.createDataFrame([(1, "a.png")], "sampleid bigint, filename string"), str(tmp_path / "m"))
    with pytest.raises(ValueError, match="repeated sampleid"):
        readers.scan_catalogue(spark, str(tmp_path / "c"), str(tmp_path / "m"))


def test_history_record_by_hand(spark, tmp_path):
    import json

    ddl = ("prediction_id string, filename string, width int, height int, solar_pixels bigint, calibration_type string, calibration_status string, cal_gsd double,"
           "cal_gsd_x double, cal_gsd_y double, cal_pixel_area_m2 double, rejection_reason string, citation string, gsd_provenance string, crs_name string,"
           "solar_area_m2 double, physical_area_status string, energy_reasons array<string>")
    rows = [
        ("a", "a.tif", 200, 100, 333, "AUTOMATIC", "EXTRACTED_METADATA", 0.3125, 0.3125, 0.25, 0.078125, None, None, "projected", "EPSG:32643", 26.02, "calculated", []),
        ("b", "b.png", 200, 100, 0, "MANUAL", "USER_SUPPLIED", 0.3, 0.3, 0.3, 0.09, None, " flight log ", None, None, 0.0, "calculated", ["ghi_missing"]),
        ("c", "c.png", 200, 100, 7, "MANUAL", "REJECTED", None, None, None, None, "gsd_not_positive", None, None, None, None, "insufficient_data", ["area_unavailable"]),
        ("d", "d.png", 0, 0, 0, "NONE", "UNAVAILABLE", None, None, None, None, None, None, None, None, None, "insufficient_data", ["area_unavailable"]),
        (None, "no id", 1, 1, 0, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    made = history.history_record(spark.createDataFrame(rows, ddl), "net", 0.4, 12)
    path = str(tmp_path / "log")
    history.history_upsert(made, path)
    got = {r.prediction_id: r for r in history.history_current(spark.read.schema(HISTORY).parquet(path)).collect()}
    assert set(got) == set("abcd")  # an entry without an id is not persisted
    a, b, c, d = (got[i] for i in "abcd")
    assert (a.source_resolution, b.source_resolution, c.source_resolution) == ("0.312m x 0.250m/px", "0.3000 m/pixel (User-Supplied)", None)
    assert [r.gsd_status for r in (a, b, c, d)] == ["VALIDATED", "USER_SUPPLIED", "UNAVAILABLE", "UNAVAILABLE"]
    assert [r.metadata_provenance for r in (a, b, c, d)] == ["projected", "flight log", "unreferenced", "unreferenced"]
    assert [r.calibration_source for r in (a, b, c)] == ["Embedded GeoTIFF (EPSG:32643)", "flight log", "Rejected user input"]
    assert (a.solar_coverage_percent, d.solar_coverage_percent, a.total_image_pixels) == (1.665, None, 20_000)
    assert (a.physical_area_hectares, c.physical_area_hectares, b.custom_gsd, a.custom_gsd, c.custom_gsd) == (0.0026, None, 0.3, None, None)
    assert (a.mask_url, a.applied_threshold, a.applied_min_component_area, a.model_name, a.status) == ("/outputs/a/mask", 0.4, 12, "net", "success")
    assert c.calibration_rejection_reason == "gsd_not_positive" and a.detected_region_count is None and a.co2_status is None
    assert json.loads(b.details)["energy"]["energy_reasons"] == ["ghi_missing"] and set(json.loads(a.details)) == {"area", "energy", "co2", "geospatial", "calibration"}
    # a scene without an id gets one, and its addresses carry it
    fresh = history.history_record(spark.createDataFrame([("x.png", 5)], "filename string, solar_pixels bigint")).first()
    assert len(fresh.prediction_id) == 36 and fresh.overlay_url == f"/outputs/{fresh.prediction_id}/overlay"
