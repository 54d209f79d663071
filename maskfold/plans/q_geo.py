"""Queries on the catalogue, georeferencing and physics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, parsing, physics
from ..operators import catalogue, masks
from .fixtures import sql_half_even as he
from .q_masks import ROWS, labels_cte, pred_runs
from .registry import query


def scenes_df(t):
    df = t.fx_scene.withColumns({"latitude": F.col("lat_e6") / 1e6, "longitude": F.col("lon_e6") / 1e6})
    return geo.geo_flags(df)


SC = """sc as (select *, lat_e6 / 1e6 as latitude, lon_e6 / 1e6 as longitude,
  lat_e6 between -90000000 and 90000000 and lon_e6 between -180000000 and 180000000 as is_valid_geo_range,
  lat_e6 between 8000000 and 38000000 and lon_e6 between 68000000 and 98000000 as is_within_bounds from fx_scene)"""


@query("p1_parse_sample_id", "fx_scene fx_file", """with f as (select filename from fx_scene union all select path from fx_file
  union all select concat('0', cast(image_id as string), '_1_benchmark.JPG') from fx_scene),
b as (select regexp_extract(filename, '[^/]*$') as n from f)
select n as name, try_cast(coalesce(nullif(regexp_extract(n, '(?i)^(\\d+)(?:\\.0)?_1(?:\\.0)?(?:_benchmark)?\\.(?:png|jpg|jpeg)$', 1), ''),
  nullif(regexp_extract(n, '(?i)^(\\d+)\\.(?:png|jpg|jpeg)$', 1), '')) as bigint) as sampleid from b""")
def _(t):
    names = t.fx_scene.select("filename").unionAll(t.fx_file.select("path")).unionAll(
        t.fx_scene.select(F.concat(F.lit("0"), F.col("image_id").cast("string"), F.lit("_1_benchmark.JPG"))))
    return names.select(parsing.base_name(F.col("filename")).alias("name"), parsing.parse_sample_id(F.col("filename")).alias("sampleid"))


@query("p2_parse_strip", "fx_scene", """select image_id, case when image_id % 4 = 0 then null else cast(strip as string) end as strip from fx_scene""")
def _(t):
    name = F.when(F.col("image_id") % 4 == 0, F.concat(F.lit("img_"), F.col("strip"), F.lit("_1.bmp"))).when(
        F.col("image_id") % 4 == 1, F.concat(F.lit("PV01_"), F.col("strip"), F.lit("_"), F.col("image_id"), F.lit("_label.bmp"))
    ).otherwise(F.concat(F.lit("/a/b/PV01_"), F.col("strip"), F.lit("_"), F.col("image_id"), F.lit(".bmp")))
    return t.fx_scene.select("image_id", parsing.parse_strip(name).alias("strip"))


@query("p3_geo_flags", "fx_scene", "with " + SC + "select image_id, latitude, longitude, cast(is_valid_geo_range as int) as valid, cast(is_within_bounds as int) as inside from sc")
def _(t):
    return scenes_df(t).select("image_id", "latitude", "longitude", F.col("is_valid_geo_range").cast("int").alias("valid"), F.col("is_within_bounds").cast("int").alias("inside"))


@query("p8_route_strategy", "fx_scene", """with d as (select image_id, case when image_id % 3 = 0 then 256 else 200 + image_id % 900 end as w, case when image_id % 3 = 0 then 256 when image_id % 3 = 1 then 200 + image_id % 900 else 200 + strip end as h from fx_scene)
select image_id, w, h, case when w = 256 and h = 256 then 'direct' when w = h and w <= 640 then 'direct' when greatest(w, h) > 640 then 'tiled' else 'letterbox' end as strategy from d""")
def _(t):
    i = F.col("image_id")
    d = t.fx_scene.select("image_id", F.when(i % 3 == 0, 256).otherwise(200 + i % 900).alias("w"),
                          F.when(i % 3 == 0, 256).when(i % 3 == 1, 200 + i % 900).otherwise(200 + F.col("strip")).alias("h"))
    return d.withColumn("strategy", parsing.route_strategy(F.col("w"), F.col("h")))


@query("p15_landing_quarantine", "fx_file", """select coalesce(case when not list_contains(['.png', '.jpg', '.jpeg', '.tif', '.tiff', '.bmp', '.webp'], lower(regexp_extract(path, '\\.[^./]+$'))) then 'unsupported_extension'
  when length = 0 then 'empty_file' when length > 52428800 then 'too_large' end, 'accepted') as outcome, count(*) as files, cast(sum(length) as bigint) as bytes from fx_file group by 1""")
def _(t):
    return parsing.landing_quarantine(t.fx_file).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("p16_valid_uuid4", "fx_history", """select seq, case when seq % 5 = 0 then 0 else 1 end as valid from fx_history""")
def _(t):
    hexs = F.md5(F.col("seq").cast("string"))
    uid = F.concat_ws("-", *[F.substring(hexs, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    uid = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("x"), uid)).otherwise(uid)
    return t.fx_history.select("seq", parsing.valid_uuid4(uid).cast("int").alias("valid"))


@query("p18_normalise_mask", "fx_raster", "select image_id, cast(sum(gt) as bigint) as solar_pixels from fx_raster group by image_id")
def _(t):
    px = t.fx_raster.select("image_id", (F.col("gt") * F.when(F.col("image_id") % 2 == 0, 255).otherwise(1)).alias("v"))
    return catalogue.normalise_mask(px).groupBy("image_id").agg(F.sum("v").alias("solar_pixels"))


@query("h24_unit_match", "fx_scene", "select image_id, case when image_id % 3 = 2 then 0 else 1 end as ok from fx_scene")
def _(t):
    u = F.when(F.col("image_id") % 3 == 0, " KW-hr / m^2/Day").when(F.col("image_id") % 3 == 1, "kWh/m2/day").otherwise("MJ/m2/day")
    return t.fx_scene.select("image_id", parsing.unit_ok(u, ["kW-hr/m^2/day", "kWh/m2/day"]).cast("int").alias("ok"))


@query("j1_catalogue_join", "fx_scene", "with " + SC + "select m.image_id, m.filename, m.split, c.latitude, c.longitude from fx_scene m join sc c on c.sampleid = m.sampleid")
def _(t):
    coords = scenes_df(t).select("sampleid", "latitude", "longitude")
    return catalogue.catalogue(coords, t.fx_scene.select("sampleid", "image_id", "filename", "split")).drop("sampleid")


FILES = """files as (select image_id, case image_id % 4 when 0 then filename when 1 then concat(cast(image_id as string), '.png') when 2 then concat('0', cast(image_id as string), '_1.jpg') else concat('unknown_', filename) end as filename from fx_scene)"""


def files_df(t):
    i, s = F.col("image_id"), F.col("image_id").cast("string")
    name = F.when(i % 4 == 0, F.col("filename")).when(i % 4 == 1, F.concat(s, F.lit(".png"))).when(
        i % 4 == 2, F.concat(F.lit("0"), s, F.lit("_1.jpg"))).otherwise(F.concat(F.lit("unknown_"), F.col("filename")))
    return t.fx_scene.select("image_id", name.alias("filename"))


@query("j2_lookup_fallback", "fx_scene", "with " + FILES + "select image_id, filename, case when image_id % 4 = 3 then null else image_id end as sampleid from files")
def _(t):
    return catalogue.lookup(files_df(t), t.fx_scene.select("sampleid", "filename")).select("image_id", "filename", "sampleid")


@query("a32_match_audit", "fx_scene", "select count(*) as images, count(*) filter (where image_id % 4 <> 3) as matched, count(*) filter (where image_id % 4 = 3) as unmatched, 'LEVEL_B' as georeferencing_level from fx_scene")
def _(t):
    return catalogue.match_audit(catalogue.lookup(files_df(t), t.fx_scene.select("sampleid", "filename")))


@query("j3_annotation_attach", "fx_scene fx_gt", "select s.image_id, count(g.gt_idx) as annotation_count, cast(coalesce(sum(g.area), 0) as bigint) as annotated_area from fx_scene s left join fx_gt g on g.image_id = s.image_id group by 1")
def _(t):
    return catalogue.attach_annotations(t.fx_scene.select("image_id"), t.fx_gt)


@query("a31_bounds_audit", "fx_scene", "with " + SC + "select count(*) as total_samples, min(latitude) as min_latitude, max(latitude) as max_latitude, min(longitude) as min_longitude, max(longitude) as max_longitude, count(*) filter (where not is_within_bounds) as anomaly_count from sc")
def _(t):
    return catalogue.bounds_audit(scenes_df(t))


@query("a31_anomalies", "fx_scene", "with " + SC + "select sampleid, filename, latitude, longitude, has_solar from sc where not is_within_bounds")
def _(t):
    return catalogue.anomalies(scenes_df(t))


# ------------------------------------------------------------------ georeferencing


def geo_df(t):
    k, sx, sy = F.col("kind"), F.col("sx"), F.col("sy")
    d = F.lit(0.0)
    base = F.col("image_id") % 50
    deg = F.when(k == 2, 0.00001).otherwise(1.0)
    ox = F.when(k == 2, 70.0 + base / 10.0).otherwise(500000.0 + base)
    oy = F.when(k == 2, 10.0 + base / 2.0).otherwise(2000000.0 + base)
    scale = F.when(k == 5, F.array(d, d, d)).otherwise(F.array(sx * deg, sy * deg, d))
    m = F.array(sx, 0.1 * sx, d, ox, -0.1 * sy, -sy, d, oy, d, d, d, d, d, d, d, F.lit(1.0))
    tags = t.fx_geo.select(
        "image_id", "kind",
        F.when(k == 3, m).alias("matrix"), F.when(k != 3, scale).alias("scale"),
        F.when(k != 3, F.array(d, d, d, ox, oy, d)).alias("tiepoint"),
        F.when(k == 2, "geographic").when(k != 4, "projected").alias("crs_kind"),
        F.when(k == 1, "foot").when(k == 2, "degree").otherwise("metre").alias("map_units"),
        F.lit(640).alias("width"), F.lit(640).alias("height"),
    )
    return geo.gsd_from_affine(geo.affine_from_tags(tags))


GEO = """g0 as (select *, image_id % 50 as base, case when kind = 2 then 0.00001::double else 1.0::double end as deg from fx_geo),
g1 as (select *, case when kind = 2 then 70.0 + base / 10 else 500000.0 + base end as ox, case when kind = 2 then 10.0 + base / 2 else 2000000.0 + base end as oy from g0),
g2 as (select image_id, kind, case when kind = 5 then 0.0 when kind = 3 then sx else sx * deg end as a, case when kind = 3 then 0.1::double * sx else 0.0 end as b, ox as c,
  case when kind = 3 then -(0.1::double) * sy else 0.0 end as d, case when kind = 5 then 0.0 when kind = 3 then -sy else -(sy * deg) end as e, oy as f, case when kind = 3 then 1 else 0 end as is_rotated from g1),
g3 as (select *, abs(a * e - b * d) as det, case when kind = 1 then 0.3048::double else 1.0::double end as u, radians(e * 320.0 + f) as phi from g2),
g4 as (select *, case when kind in (0, 1, 3) then sqrt(a * a + d * d) * u when kind = 2 then radians(a) * 6378137.0::double / sqrt(1.0 - 0.0066943799901413165::double * pow(sin(phi), 2)) * cos(phi) end as gsd_x,
  case when kind in (0, 1, 3) then sqrt(b * b + e * e) * u when kind = 2 then radians(-e) * 6378137.0::double * (1.0 - 0.0066943799901413165::double) / pow(1.0 - 0.0066943799901413165::double * pow(sin(phi), 2), 1.5) end as gsd_y,
  case kind when 5 then 'singular_transform' when 4 then 'missing_crs' when 2 then 'geographic' else 'projected' end as gsd_provenance,
  case when kind in (4, 5) then 'INSUFFICIENT_DATA' else 'VALIDATED' end as gsd_status from g3),
geo as (select *, case when kind in (0, 1, 3) then det * u * u when kind = 2 then gsd_x * gsd_y end as pixel_area from g4)
"""


@query("h9_affine_from_tags", "fx_geo", "with " + GEO + "select image_id, round(a, 9) as a, round(b, 9) as b, round(c, 6) as c, round(d, 9) as d, round(e, 9) as e, round(f, 6) as f, is_rotated from geo")
def _(t):
    return geo_df(t).select("image_id", *[F.round(c, 9).alias(c) for c in "abde"], F.round("c", 6).alias("c"), F.round("f", 6).alias("f"), "is_rotated")


@query("h10_gsd_from_affine", "fx_geo", "with " + GEO + "select image_id, gsd_provenance, gsd_status, round(gsd_x, 6) as gsd_x, round(gsd_y, 6) as gsd_y, round(pixel_area, 6) as pixel_area_m2 from geo where kind <> 2")
def _(t):
    return geo_df(t).where("kind <> 2").select("image_id", "gsd_provenance", "gsd_status", F.round("gsd_x", 6).alias("gsd_x"), F.round("gsd_y", 6).alias("gsd_y"), F.round("geo_pixel_area_m2", 6).alias("pixel_area_m2"))


@query("h11_gsd_geographic", "fx_geo", "with " + GEO + "select image_id, gsd_status, round(gsd_x, 6) as gsd_x, round(gsd_y, 6) as gsd_y, round(pixel_area, 6) as pixel_area_m2 from geo where kind = 2")
def _(t):
    return geo_df(t).where("kind = 2").select("image_id", "gsd_status", F.round("gsd_x", 6).alias("gsd_x"), F.round("gsd_y", 6).alias("gsd_y"), F.round("geo_pixel_area_m2", 6).alias("pixel_area_m2"))


@query("h12_centroid_geo", "fx_geo fx_raster", "with recursive " + GEO + "," + labels_cte("pred = 1", "px") + """,
reg as (select image_id, label, round(sum(x) / count(*), 6) as cx, round(sum(y) / count(*), 6) as cy from px_lab group by 1, 2)
select r.image_id, r.label, case when g.kind is not null then round(a * cx + b * cy + c, 4) end as map_x, case when g.kind is not null then round(d * cx + e * cy + f, 4) end as map_y,
  case when g.kind is not null then 'available' else 'unavailable_no_affine_transform' end as centroid_status from reg r left join geo g on g.image_id = r.image_id and g.kind <> 4""")
def _(t):
    regions = masks.region_table(masks.label_runs(pred_runs(t)))
    aff = geo_df(t).where("kind <> 4").select("image_id", *"abcdef")
    return geo.centroid_geo(regions.join(aff, "image_id", "left")).select("image_id", "label", F.round("map_x", 4).alias("map_x"), F.round("map_y", 4).alias("map_y"), "centroid_status")


MAN = """man as (select image_id, gsd, citation, case when gsd is null then 'gsd_missing' when gsd <= 0 then 'gsd_not_positive' when gsd < 0.005 then 'gsd_below_plausible' when gsd > 100 then 'gsd_above_plausible'
  when gsd in (1.0, 0.5) and coalesce(length(trim(citation)), 0) < 8 then 'gsd_generic_assumption' end as reason from fx_manual)"""


@query("h13_validate_gsd", "fx_manual", "with " + MAN + """select image_id, reason as calibration_reason,
  case when gsd is null then 'gsd_missing' when gsd <= 0 then 'gsd_not_positive' when gsd in (1.0, 0.5) then 'gsd_generic_assumption' when gsd > 500 then 'gsd_above_plausible' when coalesce(length(trim(citation)), 0) < 10 then 'gsd_without_citation' end as provider_reason from man""")
def _(t):
    return t.fx_manual.select("image_id", geo.gsd_reason(F.col("gsd").cast("double"), F.col("citation")).alias("calibration_reason"),
                              geo.gsd_reason(F.col("gsd").cast("double"), F.col("citation"), "provider").alias("provider_reason"))


CAL = "with " + GEO + "," + MAN + """,
cal as (select m.image_id, case when g.gsd_status = 'VALIDATED' then 'AUTOMATIC' when m.gsd is not null then 'MANUAL' else 'NONE' end as calibration_type,
  case when g.gsd_status = 'VALIDATED' then 'EXTRACTED_METADATA' when m.gsd is not null and m.reason is null then 'USER_SUPPLIED' when m.gsd is not null then 'REJECTED' else 'UNAVAILABLE' end as calibration_status,
  """ + he("case when g.gsd_status = 'VALIDATED' then g.gsd_x when m.reason is null then m.gsd end", 4) + """ as cal_gsd, """ + he("case when g.gsd_status = 'VALIDATED' then g.pixel_area when m.reason is null then m.gsd * m.gsd end", 6) + """ as cal_pixel_area_m2,
  case when g.gsd_status = 'VALIDATED' then null when m.gsd is not null then m.reason end as rejection_reason, case when g.gsd_status = 'VALIDATED' and m.gsd is not null then 1 else 0 end as override_ignored
  from man m left join geo g on g.image_id = m.image_id and m.image_id % 3 <> 1)
"""


def calibration_df(t):
    tags = geo_df(t).where("image_id % 3 <> 1").drop("kind")
    both = t.fx_manual.withColumn("gsd", F.col("gsd").cast("double")).join(tags, "image_id", "left")
    return geo.resolve_calibration(both)


@query("j22_calibration_precedence", "fx_geo fx_manual", CAL + "select * from cal")
def _(t):
    return calibration_df(t).select("image_id", "calibration_type", "calibration_status", "cal_gsd", "cal_pixel_area_m2", "rejection_reason", "override_ignored")


# ------------------------------------------------------------------ physics

AREA = CAL + """,
ar as (select *, (image_id * 37) % 5000 as solar_pixels, """ + he("(image_id * 37) % 5000 * cal_pixel_area_m2", 2) + """ as area from cal)
"""


def area_df(t):
    df = calibration_df(t).withColumns({"solar_pixels": (F.col("image_id") * 37) % 5000, "total_pixels": F.lit(409600).cast("bigint")})
    return physics.physical_area(df)


@query("h14_physical_area", "fx_geo fx_manual", AREA + "select image_id, solar_pixels, area as solar_area_m2, " + he("area / 10000", 4) + " as area_hectares, case when area is null then 'insufficient_data' else 'calculated' end as physical_area_status from ar")
def _(t):
    return area_df(t).select("image_id", "solar_pixels", "solar_area_m2", "area_hectares", "physical_area_status")


@query("s7_scan_irradiance", "fx_irradiance", """select custkey, case when ann is null then 'ann_missing' when ann < 0 then 'ann_fill_value' when not (ann between 0.1 and 12.0) then 'ann_implausible' end as reason,
  (case when jan <> -999.0 then 1 else 0 end) + (case when jul <> -999.0 then 1 else 0 end) as months, case when jul <> -999.0 then jul end as jul from fx_irradiance""")
def _(t):
    return irradiance_df(t).select("custkey", "reason", F.size("monthly_values").alias("months"), F.try_element_at("monthly_values", F.lit("JUL")).alias("jul"))


def irradiance_df(t):
    """Landed climatology responses, read back from their JSON text."""
    from ..sources.readers import parse_irradiance

    i = t.fx_irradiance
    vals = F.struct(F.col("ann").alias("ANN"), F.col("jan").alias("JAN"), F.col("jul").alias("JUL"))
    body = F.to_json(F.struct(F.struct(F.struct(vals.alias("ALLSKY_SFC_SW_DWN")).alias("parameter")).alias("properties")))
    return parse_irradiance(i.select("custkey", body.alias("body")), "body")


@query("h25_monthly_map", "fx_irradiance", """select custkey, 'JAN' as month, jan as v from fx_irradiance where jan <> -999.0 union all select custkey, 'JUL', jul from fx_irradiance where jul <> -999.0""")
def _(t):
    return irradiance_df(t).select("custkey", F.explode("monthly_values").alias("month", "v"))


@query("h16_annual_ghi", "fx_irradiance", "select custkey, case when custkey % 4 = 3 then null else " + he("ann * 365.25::double", 2) + " end as annual_ghi from fx_irradiance")
def _(t):
    unit = F.when(F.col("custkey") % 4 == 3, "MJ/m2/day").when(F.col("custkey") % 4 == 1, "kWh/m2/DAY").otherwise("kW-hr/m^2/day")
    return t.fx_irradiance.select("custkey", physics.annual_ghi(F.col("ann").cast("double"), unit).alias("annual_ghi"))


GHI = """irr as (select *, printf('%.4f|%.4f', 8.0 + (custkey * 7919) % 30000 / 1000, 68.0 + (custkey * 6101) % 30000 / 1000) as cell,
  case when ann between 0.1 and 12.0 then """ + he("ann * 365.25::double", 2) + """ end as ghi from fx_irradiance)"""


def irr_cells(t):
    ok = irradiance_df(t).withColumn("annual_ghi", F.when(F.col("reason").isNull(), physics.annual_ghi(F.col("ann"), F.lit("kW-hr/m^2/day"))))
    lat = 8.0 + F.col("custkey") * 7919 % 30000 / 1000
    lon = 68.0 + F.col("custkey") * 6101 % 30000 / 1000
    one = ok.withColumn("cell", F.format_string("%.4f|%.4f", lat, lon)).groupBy("cell").agg(F.min_by(F.struct("annual_ghi", "custkey"), "custkey").alias("r"))
    return one.select("cell", "r.annual_ghi", F.col("r.custkey").alias("source_key"))


def scene_points(t):
    """Scenes placed on their customer's climatology cell."""
    k = F.col("custkey")
    far = F.when(F.col("image_id") % 500 == 7, 40.0).otherwise(0.0)
    pts = t.fx_scene.select("image_id", "custkey", (8.0 + k * 7919 % 30000 / 1000 + far).alias("latitude"), (68.0 + k * 6101 % 30000 / 1000).alias("longitude"))
    return geo.geo_flags(pts)


@query("j23_irradiance_join", "fx_scene fx_irradiance", "with " + GHI + """, one as (select cell, min(custkey) as custkey from irr group by cell)
select s.image_id, i.ghi as annual_ghi, i.custkey as source_key from fx_scene s left join one o on s.image_id % 500 <> 7 and o.cell = printf('%.4f|%.4f', 8.0 + (s.custkey * 7919) % 30000 / 1000, 68.0 + (s.custkey * 6101) % 30000 / 1000)
left join irr i on i.custkey = o.custkey""")
def _(t):
    return catalogue.attach_irradiance(scene_points(t), irr_cells(t)).select("image_id", "annual_ghi", "source_key")


@query("j23_cache_key", "fx_irradiance", """with p as (select custkey, printf('%.4f', 8.0 + (custkey * 7919) % 30000 / 1000) as la, printf('%.4f', 68.0 + (custkey * 6101) % 30000 / 1000) as lo from fx_irradiance)
select custkey, concat('solar_res_', la, '_', lo, '_', substr(sha256(concat('NASA_POWER|', la, '|', lo, '|ALLSKY_SFC_SW_DWN|climatology')), 1, 16), '.json') as cache_key from p""")
def _(t):
    lat = 8.0 + F.col("custkey") * 7919 % 30000 / 1000
    lon = 68.0 + F.col("custkey") * 6101 % 30000 / 1000
    return t.fx_irradiance.select("custkey", physics.cache_key(lat, lon).alias("cache_key"))


EN = AREA.replace("with ", "with irr0 as (select custkey, case when ann between 0.1 and 12.0 then " + he("ann * 365.25::double", 2) + " end as ghi from fx_irradiance),", 1) + """,
scen(scenario, eff, pr, ef) as (values ('unset', null::double, null::double, null::double), ('benchmark', 0.20::double, 0.75::double, null), ('grid_average', 0.20::double, 0.75::double, 0.716::double), ('thermal', 0.20::double, 0.75::double, 0.82::double), ('custom', 0.18::double, 0.8::double, 0.65::double)),
en0 as (select a.*, i.ghi, s.* from ar a left join irr0 i on i.custkey = a.image_id % 1000 cross join scen s),
en1 as (select *, list_filter([case when area is null then 'area_unavailable' end, case when ghi is null then 'ghi_missing' end, case when not (ghi between 500 and 3500) then 'ghi_implausible' end, case when eff is null then 'efficiency_missing' end,
  case when pr is null then 'performance_ratio_missing' end], lambda r: r is not null) as reasons from en0),
en as (select *, case when len(reasons) = 0 then """ + he("area * ghi * eff * pr", 2) + """ end as kwh, case when len(reasons) = 0 then 'estimated' else 'insufficient_data' end as energy_status from en1),
co as (select *, list_concat(list_filter([case when energy_status <> 'estimated' then 'energy_unavailable' end], lambda r: r is not null), case when energy_status <> 'estimated' then reasons else [] end,
  list_filter([case when kwh > 100000000.0 then 'energy_implausible' end, case when ef is null then 'emission_factor_missing' end], lambda r: r is not null)) as creasons from en),
ck as (select *, case when len(creasons) = 0 then """ + he("kwh * ef", 2) + """ end as kg from co)
"""


def energy_df(t):
    irr = irradiance_df(t).select(F.col("custkey").alias("ik"), F.when(F.col("reason").isNull(), physics.annual_ghi(F.col("ann"), F.lit("kW-hr/m^2/day"))).alias("annual_ghi"))
    a = area_df(t).withColumn("ik", F.col("image_id") % 1000).join(irr, "ik", "left")
    return physics.energy(a.withColumn("s", F.explode(physics.scenarios(0.18, 0.80, 0.65))).select("*", "s.*").drop("s"))


@query("h15_energy", "fx_geo fx_manual fx_irradiance", EN + "select image_id, scenario, kwh as energy_kwh_year, energy_status, array_to_string(reasons, ';') as reasons from en")
def _(t):
    return energy_df(t).select("image_id", "scenario", "energy_kwh_year", "energy_status", F.array_join("energy_reasons", ";").alias("reasons"))


UNITS = AREA.replace("with ", "with irr1 as (select custkey, case when ann between 0.1 and 12.0 then ann end as daily from fx_irradiance),", 1) + """,
u0 as (select a.*, i.daily, case when image_id % 5 = 0 then 1800.0::double end as given,
  case image_id % 4 when 0 then 'kW-hr/m^2/day' when 1 then 'MJ/m^2/day' when 2 then 'kWh/m2/Day' end as unit from ar a left join irr1 i on i.custkey = a.image_id % 1000),
u1 as (select *, coalesce(unit, '') ilike '%day%' and (coalesce(unit, '') ilike '%kwh%' or coalesce(unit, '') ilike '%kw-hr%') as fits from u0),
u2 as (select *, coalesce(given, case when fits then """ + he("daily * 365.25::double", 2) + """ end) as ghi from u1),
u3 as (select *, list_filter([case when area is null then 'area_unavailable' end, case when given is null and daily is not null and not fits then 'ghi_unit_incompatible' end,
  case when ghi is null then 'ghi_missing' end, case when not (ghi between 500 and 3500) then 'ghi_implausible' end], lambda r: r is not null) as reasons from u2)
select image_id, ghi as annual_ghi, case when len(reasons) = 0 then """ + he("area * ghi * 0.2::double * 0.75::double", 2) + """ end as energy_kwh_year, array_to_string(reasons, ';') as reasons from u3"""


@query("h15_energy_units", "fx_geo fx_manual fx_irradiance", UNITS)
def _(t):
    irr = irradiance_df(t).select(F.col("custkey").alias("ik"), F.when(F.col("reason").isNull(), F.col("ann")).alias("source_daily_ghi"))
    a = area_df(t).withColumn("ik", F.col("image_id") % 1000).join(irr, "ik", "left")
    k = F.col("image_id") % 4
    a = a.withColumns({
        "source_unit": F.when(k == 0, "kW-hr/m^2/day").when(k == 1, "MJ/m^2/day").when(k == 2, "kWh/m2/Day"),
        "annual_ghi": F.when(F.col("image_id") % 5 == 0, F.lit(1800.0)), "efficiency": F.lit(0.20), "performance_ratio": F.lit(0.75),
    })
    return physics.energy(a).select("image_id", "annual_ghi", "energy_kwh_year", F.array_join("energy_reasons", ";").alias("reasons"))


@query("h17_co2", "fx_geo fx_manual fx_irradiance", EN + "select image_id, scenario, kg as co2_kg_year, " + he("kg / 1000", 4) + " as co2_tonnes_year, case when len(creasons) = 0 then 'estimated' else 'insufficient_data' end as co2_status, array_to_string(creasons, ';') as reasons from ck")
def _(t):
    return physics.co2(energy_df(t)).select("image_id", "scenario", "co2_kg_year", "co2_tonnes_year", "co2_status", F.array_join("co2_reasons", ";").alias("reasons"))


@query("h18_scenario_table", "fx_geo fx_manual fx_irradiance", EN + "select scenario, count(*) as scenes, max(eff) as efficiency, max(pr) as performance_ratio, max(ef) as emission_factor, count(kg) as with_co2 from ck group by scenario")
def _(t):
    return physics.co2(energy_df(t)).groupBy("scenario").agg(F.count("*").alias("scenes"), F.max("efficiency").alias("efficiency"), F.max("performance_ratio").alias("performance_ratio"),
                                                          F.max("emission_factor").alias("emission_factor"), F.count("co2_kg_year").alias("with_co2"))


@query("p12_readiness", "fx_geo fx_manual fx_irradiance", EN + """select scenario, case when area is not null and ghi is not null then 'READY' when ghi is not null then 'PARTIALLY_READY' else 'BLOCKED' end as area_ready,
  case when energy_status = 'estimated' then 'READY' when area is null then 'BLOCKED' else 'PARTIALLY_READY' end as energy_ready, case when kg is not null then 'READY' when energy_status = 'estimated' then 'PARTIALLY_READY' else 'BLOCKED' end as co2_ready, count(*) as n from ck group by 1, 2, 3, 4""")
def _(t):
    return physics.co2(energy_df(t)).groupBy("scenario", physics.readiness("area").alias("area_ready"), physics.readiness("energy").alias("energy_ready"), physics.readiness("co2").alias("co2_ready")).agg(F.count("*").alias("n"))


@query("p11_georef_level", "fx_scene fx_geo", "with " + SC + "," + GEO + """select s.image_id, case when g.gsd_status = 'VALIDATED' then 'LEVEL_A' when s.image_id % 4 <> 3 then 'LEVEL_B' else 'UNREFERENCED' end as level,
  case when s.image_id % 4 <> 3 and is_within_bounds then 'Surat, Gujarat, India' when g.gsd_status = 'VALIDATED' then g.gsd_provenance when s.image_id % 4 <> 3 then 'Catalog Location' end as location_name
  from sc s left join geo g on g.image_id = s.image_id""")
def _(t):
    s = scenes_df(t).select("image_id", "is_within_bounds").join(geo_df(t).select("image_id", "is_georeferenced", F.col("gsd_provenance").alias("crs_name")), "image_id", "left")
    hit, ref = F.col("image_id") % 4 != 3, F.col("is_georeferenced") == 1
    return s.select("image_id", geo.georef_level(ref, hit).alias("level"), geo.location_name(ref, hit, F.col("is_within_bounds"), F.col("crs_name")).alias("location_name"))


@query("h21_haversine", "fx_scene", "with " + SC + """select image_id, round(6371000.0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 3) as metres from (
  select image_id, pow(sin(radians(21.17 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(21.17)) * pow(sin(radians(72.83 - longitude) / 2), 2) as a from sc) q""")
def _(t):
    return scenes_df(t).select("image_id", F.round(geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(21.17), F.lit(72.83)), 3).alias("metres"))
