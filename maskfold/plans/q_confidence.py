"""Queries on probability maps and region confidence."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import confidence, masks
from .fixtures import sql_half_even as he
from .q_masks import labels_cte, pred_runs
from .registry import query

PS = [50.0, 75.0, 80.0, 85.0, 90.0, 95.0, 97.0, 98.0, 99.0, 99.5, 99.9, 100.0]
CONF = "round(greatest(p, 1 - p), 6)"


def std(v: str) -> str:
    i = f"cast(round({v} * 1000000) as hugeint)"
    return f"sqrt(cast(count({v}) * sum({i} * {i}) - sum({i}) * sum({i}) as double)) / count({v}) / 1000000.0::double"



@query("a18_confidence_histogram", "fx_raster", f"""with b as (select unnest(range(0, 10)) as bin),
c as (select image_id, case when {CONF} >= 0.9 then 9 when {CONF} >= 0.8 then 8 when {CONF} >= 0.7 then 7 when {CONF} >= 0.6 then 6 when {CONF} >= 0.5 then 5 else 0 end as bin from fx_raster),
n as (select image_id, bin, count(*) as n from c group by 1, 2), tot as (select image_id, count(*) as t from c group by 1),
j as (select tot.image_id, b.bin, t, coalesce(n, 0) as n from b cross join tot left join n on n.bin = b.bin and n.image_id = tot.image_id)
select image_id, cast(bin as int) as bin, round(bin / 10, 2) as lower_bound, round((bin + 1) / 10, 2) as upper_bound, n as pixel_count, {he("n / t * 100.0", 2)} as percentage from j""")
def _(t):
    return confidence.confidence_hist(t.fx_raster)


BR = ", ".join(f"({a}, {b})" for a, b in confidence.BRACKETS)


@query("a19_custom_histogram", "fx_raster", f"""with b(low, high) as (values {BR}),
n as (select image_id, low, high, count(*) filter (where p >= low and p < high) as k, count(*) as t from fx_raster cross join b group by 1, 2, 3)
select image_id, cast(low as double) as low, cast(high as double) as high, k as pixel_count, {he("100.0 * k / t", 2)} as percentage from n""")
def _(t):
    return confidence.custom_hist(t.fx_raster)


@query("a20_prob_stats", "fx_raster", f"""with s as (select image_id, 'solar' as part, case when pred = 1 then p end as v from fx_raster
  union all select image_id, 'background', case when pred = 0 then round(1 - p, 6) end from fx_raster union all select image_id, 'confidence', {CONF} from fx_raster),
g as (select image_id, part, count(v) as n, avg(cast(v as decimal(18, 6))) as mean, quantile_cont(v, 0.5) as median, min(v) as low, max(v) as high, {std('v')} as std from s group by 1, 2)
select image_id, part, n, {he("mean", 4)} as mean, {he("median", 4)} as median, {he("low", 4)} as min, {he("high", 4)} as max, {he("std", 4)} as std from g""")
def _(t):
    return confidence.prob_stats(t.fx_raster)


@query("a21_prob_percentiles", "fx_raster", " union all ".join(f"select {p}::double as percentile, round(quantile_cont(p, {p / 100}), 6) as value from fx_raster" for p in PS))
def _(t):
    return confidence.prob_percentiles(t.fx_raster, PS)


AMB = f"round(1 - {CONF}, 6) >= 0.4"


@query("a22_ambiguity", "fx_raster", f"""select image_id, count(*) as total_pixels, count(*) filter (where pred = 1) as solar_pixels, count(*) filter (where {AMB}) as global_ambiguous_pixels,
  count(*) filter (where {AMB} and pred = 1) as solar_ambiguous_pixels, {he(f'count(*) filter (where {AMB}) / count(*) * 100.0', 2)} as global_ambiguous_percentage,
  case when count(*) filter (where pred = 1) > 0 then {he(f'count(*) filter (where {AMB} and pred = 1) / count(*) filter (where pred = 1) * 100.0', 2)} else 0.0 end as solar_ambiguous_percentage
from fx_raster group by image_id""")
def _(t):
    return confidence.ambiguity(t.fx_raster, by=["image_id"])


@query("a23_prob_validate", "fx_raster", """select image_id, count(*) filter (where isnan(p)) as nan_count, count(*) filter (where isinf(p)) as inf_count, count(*) filter (where p < -0.0001 or p > 1.0001) as range_count,
  round(max(abs(round(1 - p, 6) + p - 1.0)), 6) as max_deviation, 1 as valid from fx_raster group by image_id""")
def _(t):
    return confidence.require_valid(confidence.prob_validate(t.fx_raster.withColumn("p_bg", F.round(1 - F.col("p"), 6))))


RC = "with recursive " + labels_cte("pred = 1", "px") + f""",
rc0 as (select l.image_id, l.label, count(*) as area, avg(cast(p as decimal(18, 6))) as m, quantile_cont(p, 0.5) as md, min(p) as lo, max(p) as hi, {std('p')} as sd,
  avg(cast({CONF} as decimal(18, 6))) as mc, avg(cast(1 - {CONF} as decimal(18, 6))) as mu
  from px_lab l join fx_raster r on r.image_id = l.image_id and r.y = l.y and r.x = l.x group by 1, 2),
rc as (select image_id, label, area, m, {he("m", 4)} as mean_probability, {he("md", 4)} as median_probability, {he("lo", 4)} as min_probability, {he("hi", 4)} as max_probability,
  {he("sd", 4)} as std_probability, {he("mc", 4)} as mean_confidence, {he("mu", 4)} as mean_uncertainty from rc0),
rb as (select *, case when m >= 0.9 then 'HIGH' when m >= 0.7 then 'MEDIUM' else 'LOW' end as band from rc)
"""


def regions_df(t):
    return confidence.region_confidence(masks.label_runs(pred_runs(t)), t.fx_raster)


@query("a24_region_confidence", "fx_raster", RC + """select image_id, label, area, mean_probability, median_probability, min_probability, max_probability, std_probability, mean_confidence, mean_uncertainty, band from rb""")
def _(t):
    return regions_df(t)


@query("a25_region_band_summary", "fx_raster", RC + f""", bs as (select image_id, count(*) as n, count(*) filter (where band = 'HIGH') as h, count(*) filter (where band = 'MEDIUM') as m, count(*) filter (where band = 'LOW') as l from rb group by image_id)
select image_id, n as total_regions, h as high_count, {he("h / n * 100.0", 2)} as high_percentage, m as medium_count, {he("m / n * 100.0", 2)} as medium_percentage, l as low_count, {he("l / n * 100.0", 2)} as low_percentage from bs""")
def _(t):
    return confidence.band_summary(regions_df(t), ["image_id"])


@query("p9_confidence_band", "fx_raster", """select case when p >= 0.9 then 'HIGH' when p >= 0.7 then 'MEDIUM' else 'LOW' end as band, count(*) as n from fx_raster group by 1""")
def _(t):
    return t.fx_raster.groupBy(confidence.confidence_band(F.col("p")).alias("band")).agg(F.count("*").alias("n"))


@query("j24_roi_stats", "fx_raster fx_image8", """with roi as (select image_id, 'corner' as roi, 0 as x1, 0 as y1, 3 as x2, 4 as y2 from fx_image8
  union all select image_id, 'centre', 2, 2, 6, 6 from fx_image8 union all select image_id, 'strip', cast(image_id % 5 as int), 0, cast(image_id % 5 as int) + 2, 8 from fx_image8)
select r.image_id, roi, count(*) as pixels, """ + he("avg(cast(p as decimal(18, 6)))", 6) + """ as mean_p, max(p) as max_p, min(p) as min_p, count(*) filter (where p >= 0.5) as over_half
from roi r join fx_raster f on f.image_id = r.image_id and f.x >= x1 and f.x < x2 and f.y >= y1 and f.y < y2 group by 1, 2""")
def _(t):
    k = (F.col("image_id") % 5).cast("int")

    def box(name, x1, y1, x2, y2):
        return F.struct(F.lit(name).alias("roi"), *[(v if not isinstance(v, int) else F.lit(v)).cast("int").alias(n) for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))])

    rois = t.fx_image8.select("image_id", F.explode(F.array(box("corner", 0, 0, 3, 4), box("centre", 2, 2, 6, 6), box("strip", k, 0, k + 2, 8))).alias("r")).select("image_id", "r.*")
    return confidence.roi_stats(t.fx_raster, rois)


@query("t7_largest_regions", "fx_raster", "with recursive " + labels_cte("pred = 1", "px") + """,
reg as (select image_id, label, count(*) as area, min(x) as bx, min(y) as by_, max(x) as bx2, max(y) as by2 from px_lab group by 1, 2),
top as (select * from (select *, row_number() over (partition by image_id order by area desc, label) as rn from reg where area >= 20) q where rn <= 15)
select t.image_id, t.label, t.area, count(*) as box_pixels, """ + he("avg(cast(p as decimal(18, 6)))", 6) + """ as mean_p, max(p) as max_p from top t join fx_raster r on r.image_id = t.image_id and r.x between bx and bx2 and r.y between by_ and by2 group by 1, 2, 3""")
def _(t):
    regions = masks.region_table(masks.label_runs(pred_runs(t)))
    top = masks.largest_regions(regions)
    rois = top.select("image_id", F.col("label").alias("roi"), "area", F.col("x").cast("int").alias("x1"), F.col("y").cast("int").alias("y1"),
                      (F.col("x") + F.col("width")).cast("int").alias("x2"), (F.col("y") + F.col("height")).cast("int").alias("y2"))
    stats = confidence.roi_stats(t.fx_raster, rois)
    return stats.join(rois.select("image_id", "roi", "area"), ["image_id", "roi"]).select(
        "image_id", F.col("roi").alias("label"), "area", F.col("pixels").alias("box_pixels"), "mean_p", "max_p")


@query("a17_region_sweep_maps", "fx_raster fx_image8", """with recursive maps as (select image_id, y, x, 'tiled' as strategy, p from fx_raster union all
  select image_id, y, x, 'letterbox', round(p * p, 6) from fx_raster),
th as (select unnest([0.2::double, 0.3, 0.4, 0.5, 0.6]) as t),
px as (select t, strategy, image_id, y, x from maps join th on p >= t),
fl(t, strategy, image_id, sy, sx, y, x) as (select t, strategy, image_id, y, x, y, x from px union select f.t, f.strategy, f.image_id, f.sy, f.sx, p.y, p.x from fl f join px p
  on p.t = f.t and p.strategy = f.strategy and p.image_id = f.image_id and abs(p.y - f.y) <= 1 and abs(p.x - f.x) <= 1),
lab as (select t, strategy, image_id, y, x, min(sy * 100 + sx) as label from fl group by all),
reg as (select t, strategy, image_id, label, count(*) as area from lab group by all),
per as (select t, strategy, image_id, sum(area) as n, count(*) as raw, count(*) filter (where area >= 10) as r10, count(*) filter (where area >= 20) as r20,
  max(area) filter (where area >= 20) as largest, avg(area) filter (where area >= 20) as mean_area from reg group by all)
select i.image_id, s.strategy, th.t as threshold, cast(coalesce(n, 0) as bigint) as solar_pixels, """ + he("coalesce(n, 0) / 64 * 100.0", 4) + """ as coverage_percent, coalesce(raw, 0) as raw_regions,
  coalesce(r10, 0) as regions_min10, coalesce(r20, 0) as regions_min20, largest, """ + he("mean_area", 2) + """ as mean_size
from fx_image8 i cross join th cross join (select unnest(['tiled', 'letterbox']) as strategy) s left join per on per.t = th.t and per.strategy = s.strategy and per.image_id = i.image_id""")
def _(t):
    px = t.fx_raster.select("image_id", "y", "x", F.lit("tiled").alias("strategy"), "p")
    px = px.unionAll(t.fx_raster.select("image_id", "y", "x", F.lit("letterbox"), F.round(F.col("p") * F.col("p"), 6)))
    maps = t.fx_image8.withColumn("strategy", F.explode(F.array(F.lit("tiled"), F.lit("letterbox"))))
    return confidence.region_sweep(px, maps, (0.2, 0.3, 0.4, 0.5, 0.6))


@query("a17_region_sweep", "fx_raster", "with recursive rs as (select r.*, th as t from fx_raster r cross join (select unnest([0.3::double, 0.4, 0.5, 0.6, 0.7]) as th) q where p >= th)," + """
px as (select t, image_id, y, x from rs),
fl(t, image_id, sy, sx, y, x) as (select t, image_id, y, x, y, x from px union select f.t, f.image_id, f.sy, f.sx, p.y, p.x from fl f join px p
  on p.t = f.t and p.image_id = f.image_id and abs(p.y - f.y) <= 1 and abs(p.x - f.x) <= 1),
lab as (select t, image_id, y, x, min(sy * 100 + sx) as label from fl group by 1, 2, 3, 4),
reg as (select t, image_id, label, count(*) as area from lab group by 1, 2, 3)
select t as threshold, cast(sum(area) as bigint) as solar_pixels, count(*) as raw_regions, count(*) filter (where area >= 10) as regions_min10, count(*) filter (where area >= 20) as regions_min20,
  max(area) as largest from reg group by t""")
def _(t):
    ts = F.array(*[F.lit(v) for v in (0.3, 0.4, 0.5, 0.6, 0.7)])
    px = t.fx_raster.withColumn("threshold", F.explode(F.filter(ts, lambda v: v <= F.col("p"))))
    runs = masks.pixels_to_runs(px, ["threshold", "image_id"])
    regions = masks.region_table(masks.label_runs(runs, ["threshold", "image_id"]), ["threshold", "image_id"])
    return regions.groupBy("threshold").agg(
        F.sum("area").alias("solar_pixels"), F.count("*").alias("raw_regions"), F.count_if(F.col("area") >= 10).alias("regions_min10"),
        F.count_if(F.col("area") >= 20).alias("regions_min20"), F.max("area").alias("largest"))
