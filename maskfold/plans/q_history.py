"""Queries on sources, sinks, history and its stream."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import physics
from ..functions.rounding import half_even
from ..operators import masks, splits
from ..sources import history, readers, sinks
from ..sources.schemas import HISTORY
from ..streaming.history_stream import stream_history
from .materialise import materialise, scratch_dir
from .fixtures import sql_half_even as he
from .q_geo import EN, energy_df
from .q_masks import labels_cte, pred_runs
from .registry import query


def fresh(t, name: str) -> str:
    return f"{scratch_dir(t.spark)}/maskfold/{name}-{uuid.uuid4().hex}"


CUR = """with cur as (select * from (select *, row_number() over (partition by rid order by seq desc) as rn from fx_history) q where rn = 1 and op <> 'delete')"""
COLS = ["rid", "seq", "created", "user_id", "event_type", "value", "op", "k"]


def current_df(t):
    return history.history_current(t.fx_history, "rid", "seq")


@query("s8_history_current", "fx_history", CUR + "select rid, seq, created, user_id, event_type, value, op, k from cur")
def _(t):
    return current_df(t)


@query("t1_page_newest", "fx_history", CUR + "select rid, created, event_type from cur order by created desc, rid limit 20 offset 40")
def _(t):
    return history.page_newest(current_df(t), 40, 20, "created", "rid").select("rid", "created", "event_type")


@query("t1_total", "fx_history", CUR + "select count(*) as total from cur")
def _(t):
    return current_df(t).agg(F.count("*").alias("total"))


@query("t2_get_one", "fx_history", CUR + "select rid, seq, value from cur where rid = 128")
def _(t):
    return history.get_one(current_df(t), 128, "rid").select("rid", "seq", "value")


@query("s11_history_upsert", "fx_history", """with log as (select rid, seq, value, op from fx_history union all select rid, seq + 100000000, value * 2, 'put' from fx_history where event_type = 'click'),
cur as (select * from (select *, row_number() over (partition by rid order by seq desc) as rn from log) q where rn = 1 and op <> 'delete') select rid, seq, value from cur""")
def _(t):
    path = fresh(t, "log")
    at = F.timestamp_micros(F.col("seq") * 1000000)
    # the state as it is, then replacements that carry an older time of their own
    first = current_df(t).select("rid", "seq", "value", at.alias("persisted_at_utc"))
    history.history_upsert(first, path, "rid")
    again = t.fx_history.where("event_type = 'click'").groupBy("rid").agg(F.max(F.struct("seq", "value")).alias("e"))
    again = again.select("rid", (F.col("e.seq") + 100000000).alias("seq"), (F.col("e.value") * 2).alias("value"), F.lit(0).cast("timestamp").alias("persisted_at_utc"))
    history.history_upsert(again, path, "rid")
    return history.history_current(t.spark.read.parquet(path), "rid").select("rid", "seq", "value")


@query("s12_history_delete", "fx_history", CUR + """, ask as (select distinct rid from fx_history where event_type = 'error')
select a.rid, case when c.rid is null then 0 else 1 end as deleted, 0 as left_over from ask a left join cur c on c.rid = a.rid""")
def _(t):
    path = fresh(t, "log")
    history.history_upsert(current_df(t).select("rid", "value", F.timestamp_micros(F.col("seq") * 1000000).alias("persisted_at_utc")), path, "rid")
    told = materialise(history.history_delete(t.spark.read.parquet(path), t.fx_history.where("event_type = 'error'").select("rid"), path, "rid"), "told")
    after = history.history_current(t.spark.read.parquet(path), "rid").select("rid", F.lit(1).alias("left"))
    return told.join(after, "rid", "left").select("rid", "deleted", F.coalesce("left", F.lit(0)).alias("left_over"))


UID = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12))"


@query("st1_stream_history", "fx_history", CUR + f", u as (select *, md5(cast(rid as string)) as h from cur) select {UID} as prediction_id, created as created_at_utc, event_type as status, round(value, 2) as physical_area_m2 from u")
def _(t):
    h = F.md5(F.col("rid").cast("string"))
    uid = F.concat_ws("-", *[F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    doc = t.fx_history.select(
        uid.alias("prediction_id"), "op", F.col("created").alias("created_at_utc"), F.timestamp_micros(F.col("seq") * 1000000).alias("persisted_at_utc"),
        F.col("event_type").alias("status"), F.round("value", 2).alias("physical_area_m2"))
    landing, log, cp = fresh(t, "landing"), fresh(t, "log"), fresh(t, "stream")
    doc.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(landing)
    stream_history(t.spark, landing, log, cp).awaitTermination()
    log_df = t.spark.read.schema(HISTORY).option("recursiveFileLookup", True).parquet(log)
    return history.history_current(log_df).select("prediction_id", F.col("created_at_utc").cast("timestamp_ntz").alias("created_at_utc"), "status", "physical_area_m2")


RECORD = EN + """,
re as (select ck.*, f.filename, f.lat_e6 / 1000000.0::double as lat, f.lon_e6 / 1000000.0::double as lon, m.citation, g.gsd_provenance as found, concat(cast(ck.image_id as string), '-', scenario) as pid,
  ck.calibration_type = 'AUTOMATIC' as auto, cal_pixel_area_m2 is not null as fine, """ + he("g.gsd_y", 4) + """ as gsd_y4, 1 + ck.image_id % 3 as regions
  from ck join fx_scene f on f.image_id = ck.image_id join man m on m.image_id = ck.image_id left join geo g on g.image_id = ck.image_id and ck.image_id % 3 <> 1),
rs as (select *, case when auto then concat('Embedded GeoTIFF (', case when image_id % 2 = 0 then 'EPSG:32643' else 'Projected CRS' end, ')') when calibration_type = 'MANUAL' and not fine then coalesce(citation, 'Rejected user input')
  when calibration_type = 'MANUAL' then trim(citation) else 'Unreferenced standard raster without calibration' end as source from re)
"""
REC_VIEWS = "fx_geo fx_manual fx_irradiance fx_scene"
FIELDS = """pid as prediction_id, filename, 'success' as status, 'any' as model_name, 640 as image_width, 640 as image_height, cast(409600 as bigint) as total_image_pixels, cast(solar_pixels as bigint) as solar_area_pixels,
  """ + he("solar_pixels * 100.0::double / 409600", 4) + """ as solar_coverage_percent, cast(regions as bigint) as detected_region_count, cast(solar_pixels // regions + solar_pixels % regions as bigint) as largest_region_area_pixels, cast(solar_pixels // regions as bigint) as smallest_region_area_pixels,
  """ + he("solar_pixels / cast(regions as double)", 4) + """ as mean_region_area_pixels, area as physical_area_m2, """ + he("area / 10000", 4) + """ as physical_area_hectares, case when area is null then 'insufficient_data' else 'calculated' end as physical_area_status,
  energy_status, kwh as estimated_energy_kwh_year, case when kg is null then 'insufficient_data' else 'estimated' end as co2_status, kg as co2_avoided_kg_year, """ + he("kg / 1000", 4) + """ as co2_avoided_tonnes_year,
  lat as latitude, lon as longitude, 'LEVEL_B' as georeferencing_level, cast(null as string) as location_name, concat('/outputs/', pid, '/mask') as mask_url, concat('/outputs/', pid, '/overlay') as overlay_url, concat('/outputs/', pid, '/original') as original_image_url,
  0.35::double as applied_threshold, 20 as applied_min_component_area, 'resize' as processing_strategy, case when not fine then 'UNAVAILABLE' when auto then 'VALIDATED' else 'USER_SUPPLIED' end as gsd_status,
  case when fine and auto then printf('%.3fm x %.3fm/px', """ + he("cal_gsd", 3) + ", " + he("gsd_y4", 3) + """) when fine then printf('%.4f m/pixel (User-Supplied)', cal_gsd) end as source_resolution,
  case when image_id % 2 = 0 then 'EPSG:32643' end as source_crs, case when fine and not auto then source else coalesce(found, 'unreferenced') end as metadata_provenance, calibration_type, calibration_status, source as calibration_source,
  case when calibration_type = 'MANUAL' then cal_gsd end as custom_gsd, rejection_reason as calibration_rejection_reason"""


def record_df(t):
    px, n = F.col("solar_pixels"), 1 + F.col("image_id") % 3
    df = physics.co2(energy_df(t)).drop("width", "height").join(t.fx_scene.select("image_id", "filename", "width", "height", "lat_e6", "lon_e6"), "image_id")
    df = df.withColumns({
        "prediction_id": F.concat_ws("-", "image_id", "scenario"), "latitude": F.col("lat_e6") / 1e6, "longitude": F.col("lon_e6") / 1e6, "georeferencing_level": F.lit("LEVEL_B"),
        "crs_name": F.when(F.col("image_id") % 2 == 0, "EPSG:32643"), "processing_strategy": F.lit("resize"), "created_at_utc": F.timestamp_seconds("image_id"),
        "region_count": n, "largest_region": F.floor(px / n) + px % n, "smallest_region": F.floor(px / n), "mean_region": half_even(px / n, 4)})
    return history.history_record(df, "any", 0.35, 20)


@query("h26_history_record", REC_VIEWS, RECORD + "select " + FIELDS + " from rs")
def _(t):
    # appended to a log and read back as the current state
    path = fresh(t, "records")
    history.history_upsert(record_df(t), path)
    log = t.spark.read.schema(HISTORY).parquet(path)
    return history.history_current(log).drop(*history.LOG_COLUMNS, "created_at_utc", "details")


@query("h26_record_details", REC_VIEWS, RECORD + """select pid as prediction_id, cal_pixel_area_m2 as area_pixel_area, area as area_m2, array_to_string(reasons, ';') as energy_reasons, kwh as energy_kwh, array_to_string(creasons, ';') as co2_reasons, ef as emission_factor,
  found as gsd_provenance, calibration_status, source as calibration_source from rs""")
def _(t):
    shape = """area struct<cal_pixel_area_m2:double,solar_area_m2:double>, energy struct<energy_reasons:array<string>,energy_kwh_year:double>,
        co2 struct<co2_reasons:array<string>,emission_factor:double>, geospatial struct<gsd_provenance:string>, calibration struct<calibration_status:string,calibration_source:string>"""
    d = record_df(t).select("prediction_id", F.from_json("details", shape).alias("d"))
    return d.select(
        "prediction_id", F.col("d.area.cal_pixel_area_m2").alias("area_pixel_area"), F.col("d.area.solar_area_m2").alias("area_m2"), F.array_join("d.energy.energy_reasons", ";").alias("energy_reasons"),
        F.col("d.energy.energy_kwh_year").alias("energy_kwh"), F.array_join("d.co2.co2_reasons", ";").alias("co2_reasons"), F.col("d.co2.emission_factor").alias("emission_factor"),
        "d.geospatial.gsd_provenance", "d.calibration.calibration_status", "d.calibration.calibration_source")


# ------------------------------------------------------------------ sources and sinks, written and read back


@query("s1_scan_catalogue", "fx_scene", "select image_id as sampleid, filename, lat_e6 / 1e6 as latitude, lon_e6 / 1e6 as longitude, has_solar from fx_scene")
def _(t):
    s, path = t.fx_scene, fresh(t, "catalogue")
    # columns are found by their header, in any order and beside others
    sinks.write_csv(s.select("sampleid", (F.col("lon_e6") / 1e6).alias("longitude"), (F.col("lat_e6") / 1e6).alias("latitude"), "has_solar"), f"{path}/coords")
    sinks.write_csv(s.select("filename", F.lit("x").alias("note"), "sampleid"), f"{path}/manifest")
    return readers.scan_catalogue(t.spark, f"{path}/coords", f"{path}/manifest").select("sampleid", "filename", "latitude", "longitude", "has_solar")


@query("s2_scan_manifests", "fx_scene", "select sampleid, filename, has_solar, width, split as source from fx_scene where has_solar = 1 union all select sampleid, filename, has_solar, null, concat('negative_', split) from fx_scene where has_solar = 0")
def _(t):
    s, path, files = t.fx_scene, fresh(t, "manifests"), {}
    for split in ("train", "val", "test"):
        sinks.write_csv(s.where((F.col("split") == split) & (F.col("has_solar") == 1)).select("sampleid", "filename", "has_solar", "width"), f"{path}/{split}")
        sinks.write_csv(s.where((F.col("split") == split) & (F.col("has_solar") == 0)).select("sampleid", "filename", "has_solar"), f"{path}/negative_{split}")
        files |= {split: f"{path}/{split}", f"negative_{split}": f"{path}/negative_{split}"}
    return readers.scan_manifests(t.spark, files).select("sampleid", "filename", "has_solar", "width", "source")


@query("s3_scan_coco", "fx_gt fx_scene", "select g.image_id, s.filename as file_name, g.gt_idx as id, cast(g.area as double) as area, 8 as numbers from fx_gt g join fx_scene s on s.image_id = g.image_id")
def _(t):
    path = fresh(t, "coco")
    ring = F.array(F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")]))
    ann = F.struct(F.col("gt_idx").alias("id"), F.col("image_id"), F.col("area"), F.lit(0).alias("iscrowd"), ring.alias("segmentation"))
    img = F.struct(F.col("image_id").alias("id"), F.concat(F.lit("images/"), F.col("filename")).alias("file_name"), "width", "height")
    docs = t.fx_gt.select(F.to_json(F.struct(F.array(ann).alias("annotations"))).alias("value")).unionAll(
        t.fx_scene.select(F.to_json(F.struct(F.array(img).alias("images"))).alias("value")))
    docs.write.text(path)
    images, polygons, _ = readers.scan_coco(t.spark, path, multi_line=False)
    j = polygons.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id")
    return j.select("image_id", "file_name", "id", "area", F.size(F.element_at("segmentation", 1)).alias("numbers"))


@query("s4_scan_split_ids", "fx_scene", "select split, image_id from fx_scene")
def _(t):
    path = fresh(t, "splits")
    t.fx_scene.select(F.to_json(F.create_map("split", F.array("image_id"))).alias("value")).write.text(path)
    return readers.scan_split_ids(t.spark, path, whole_file=False)


@query("s5_scan_metrics", "fx_labelled", "select image_id, cand_id, score_pct / 100 as score, kind from fx_labelled cross join (select unnest(['csv', 'parquet']) as kind) k")
def _(t):
    path = fresh(t, "metrics")
    rows = t.fx_labelled.select((F.col("score_pct") / 100).alias("score"), F.lit("x").alias("other"), "cand_id", "image_id")  # not in the order of the schema
    rows.write.parquet(f"{path}/parquet")
    sinks.write_csv(rows, f"{path}/rows.csv")
    schema = "image_id bigint, cand_id bigint, score double"
    return readers.scan_metrics(t.spark, f"{path}/parquet", schema).withColumn("kind", F.lit("parquet")).unionAll(
        readers.scan_metrics(t.spark, f"{path}/rows.csv", schema).withColumn("kind", F.lit("csv")))


@query("s6_file_inventory", "fx_file", """with f as (select regexp_replace(path, '\\.[^./]+$', '') as stem, path, length from fx_file)
select path, case when length = 0 then null else concat(stem, '_label.png') end as mask_path from f""")
def _(t):
    stem = F.regexp_extract("path", r"^(.*)\.[^./\\]+$", 1)
    labels = t.fx_file.where("length > 0").select(F.concat(stem, F.lit("_label.png")).alias("path"), "length")
    paired, missing = readers.pair_masks(t.fx_file.select("path", "length").unionAll(labels))
    return paired.select("path", "mask_path").unionAll(missing.select("path", "mask_path"))


@query("s6_world_files", "fx_file", """with a as (select path, length from fx_file union all
  select regexp_replace(path, '\\.[^./]+$', case length % 3 when 0 then '.pgw' else '.WLD' end), 1 from fx_file where length % 4 < 2),
n as (select regexp_extract(path, '^(.*?)[^/]*$', 1) as folder, regexp_extract(path, '([^/]*)\\.[^./]+$', 1) as stem, lower(regexp_extract(path, '\\.([^./]+)$', 1)) as ending from a),
p as (select folder, stem, count(*) filter (where ending in ('png', 'jpg')) as i, count(*) filter (where ending in ('pgw', 'tfw', 'jgw', 'wld')) as w from n group by 1, 2)
select folder, cast(sum(i) as bigint) as images, cast(sum(w) as bigint) as world_files, cast(sum(case when w > 0 then i else 0 end) as bigint) as with_world_file from p group by 1""")
def _(t):
    ending = F.when(F.col("length") % 3 == 0, ".pgw").otherwise(".WLD")
    world = t.fx_file.where("length % 4 < 2").select(F.concat(F.regexp_extract("path", r"^(.*)\.[^./]+$", 1), ending).alias("path"), F.lit(1).alias("length"))
    return readers.world_file_count(t.fx_file.select("path", "length").unionAll(world))


REG = "with recursive " + labels_cte("pred = 1", "px") + ", reg as (select image_id, label, count(*) as area from px_lab group by 1, 2)"


@query("s9_sink_table_csv", "fx_raster", REG + "select image_id, label, area from reg")
def _(t):
    path = fresh(t, "regions")
    sinks.write_csv(masks.region_table(masks.label_runs(pred_runs(t))).select("image_id", "label", "area"), path)
    return t.spark.read.schema("image_id bigint, label bigint, area bigint").option("header", True).csv(path)


@query("s10_sink_report_json", "fx_raster fx_image8", REG + "select i.image_id, count(r.label) as n_regions, cast(coalesce(sum(area), 0) as bigint) as pixels from fx_image8 i left join reg r on r.image_id = i.image_id group by 1")
def _(t):
    path = fresh(t, "reports")
    regions = masks.region_table(masks.label_runs(pred_runs(t))).select("image_id", "label", "area")
    sinks.write_reports(sinks.report_rows(t.fx_image8, regions), path)
    back = t.spark.read.schema("image_id bigint, part int, parts int, regions array<struct<label:bigint,area:bigint>>").json(path)
    pixels = F.aggregate("regions", F.lit(0).cast("bigint"), lambda a, r: a + r["area"])
    whole = back.groupBy("image_id").agg(F.sum(F.size("regions")).alias("n_regions"), F.sum(pixels).alias("pixels"), F.count("*").alias("n"), F.max("parts").alias("parts"))
    return whole.where("n = parts").drop("n", "parts")


@query("s13_sink_prob_map", "fx_raster", "select image_id, y, count(*) as n, round(sum(cast(p as float)), 4) as total from fx_raster group by 1, 2")
def _(t):
    path = fresh(t, "probs")
    sinks.write_prob(t.fx_raster, path)
    back = t.spark.read.schema("image_id bigint, y int, x0 int, probs array<float>").parquet(path)
    return back.select("image_id", "y", F.size("probs").cast("bigint").alias("n"), F.round(F.aggregate("probs", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("s14_sink_split_manifests", "fx_scene", "select split, case when has_solar = 1 then 'positive_annotated' else 'negative' end as dataset_type, count(*) as rows from fx_scene group by 1, 2")
def _(t):
    path = fresh(t, "locked")
    kind = F.when(F.col("has_solar") == 1, "positive_annotated").otherwise("negative")
    sinks.write_splits(splits.tag(t.fx_scene, F.col("split"), kind), path)
    back = t.spark.read.schema("image_id bigint, split string, dataset_type string").parquet(f"{path}/rows")
    return back.groupBy("split", "dataset_type").agg(F.count("*").alias("rows"))
