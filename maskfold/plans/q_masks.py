"""Queries on masks, regions and pixel confusion."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images, masks
from .fixtures import MODELS
from .fixtures import sql_half_even as he
from .registry import query

# twins -----------------------------------------------------------------------------------------

# covered pixels per key, row by row with merged intervals
ROWS = """
rowruns as (select {keys}, unnest(range(y0, y1)) as y, x0, x1 from {src}),
spans as (select *, max(x1) over (partition by {keys}, y order by x0, x1 rows between unbounded preceding and 1 preceding) as prev from rowruns),
covered as (select {keys}, sum(greatest(0, x1 - greatest(x0, coalesce(prev, x0)))) as area from spans group by {keys})
"""

CONFUSION_CTES = """
lay as (select '' as model, image_id, 'g' as layer, y0, y1, x0, x1 from fx_gt
  union all select model, image_id, 'p', y0, y1, x0, x1 from fx_det
  union all select model, image_id, 'u', y0, y1, x0, x1 from fx_det
  union all select unnest(['m0', 'm1', 'm2']), image_id, 'u', y0, y1, x0, x1 from fx_gt),
""" + ROWS.format(keys="model, image_id, layer", src="lay") + """,
base as (select unnest(['m0', 'm1', 'm2']) as model, image_id, width * height as total from fx_scene),
conf as (select b.model, b.image_id, cast(b.total as bigint) as total_pixels,
    cast(coalesce(g.area, 0) as bigint) as gt_pixels, cast(coalesce(p.area, 0) as bigint) as pred_pixels,
    cast(coalesce(g.area, 0) + coalesce(p.area, 0) - coalesce(u.area, 0) as bigint) as tp,
    cast(b.total - coalesce(u.area, 0) as bigint) as tn,
    cast(coalesce(u.area, 0) - coalesce(g.area, 0) as bigint) as fp,
    cast(coalesce(u.area, 0) - coalesce(p.area, 0) as bigint) as fn,
    cast(coalesce(p.area, 0) - coalesce(g.area, 0) as bigint) as pixel_diff
  from base b
  left join covered g on g.layer = 'g' and g.image_id = b.image_id
  left join covered p on p.layer = 'p' and p.image_id = b.image_id and p.model = b.model
  left join covered u on u.layer = 'u' and u.image_id = b.image_id and u.model = b.model)
"""


def labels_cte(bit: str, name: str, cond: str = "true", near: str = "") -> str:
    """Components of an 8 x 8 bit raster by flooding from every pixel; label = first pixel."""
    return f"""
{name}_px as (select image_id, y, x from fx_raster where {bit}),
{name}_flood(image_id, sy, sx, y, x) as (
  select image_id, y, x, y, x from {name}_px
  union
  select f.image_id, f.sy, f.sx, p.y, p.x from {name}_flood f join {name}_px p
    on p.image_id = f.image_id and abs(p.y - f.y) <= 1 and abs(p.x - f.x) <= 1 {near}),
{name}_lab as (select image_id, y, x, min(sy * 2147483648 + sx) as label from {name}_flood group by image_id, y, x)
"""


def confusion_df(t):
    return images.confusion(t.fx_gt, t.fx_det, t.fx_scene, MODELS)


def pred_runs(t, bit="pred = 1"):
    return masks.pixels_to_runs(t.fx_raster.where(bit))


@query("a2_pixel_coverage", "fx_gt fx_scene", "with " + ROWS.format(keys="image_id", src="fx_gt") + """
select s.image_id, cast(coalesce(area, 0) as bigint) as solar_pixels, cast(width * height - coalesce(area, 0) as bigint) as background_pixels,
  cast(width * height as bigint) as total_pixels, """ + he("coalesce(area, 0) / (width * height) * 100.0", 4) + """ as coverage_percent
from fx_scene s left join covered c on c.image_id = s.image_id""")
def _(t):
    return masks.coverage(images.covered_area(t.fx_gt), t.fx_scene)


@query("h27_mask_bbox", "fx_gt", """
select image_id, cast(min(x0) as bigint) as bbox_x1, cast(min(y0) as bigint) as bbox_y1,
  cast(max(x1) - 1 as bigint) as bbox_x2, cast(max(y1) - 1 as bigint) as bbox_y2 from fx_gt group by image_id""")
def _(t):
    return masks.mask_bbox(t.fx_gt, ["image_id"])


@query("j18_pixel_confusion", "fx_gt fx_det fx_scene", "with " + CONFUSION_CTES + """
select model, image_id, tp, tn, fp, fn, total_pixels, gt_pixels, pred_pixels, pixel_diff from conf""")
def _(t):
    return confusion_df(t)


C1_REGIONS = """
select image_id, label, count(*) as area, cast(min(x) as bigint) as x, cast(min(y) as bigint) as y,
  cast(max(x) - min(x) + 1 as bigint) as width, cast(max(y) - min(y) + 1 as bigint) as height,
  round(sum(x) / count(*), 6) as centroid_x, round(sum(y) / count(*), 6) as centroid_y
from px_lab group by image_id, label"""


@query("c1_components_8", "fx_raster", "with recursive " + labels_cte("pred = 1", "px") + C1_REGIONS)
def _(t):
    return masks.region_table(masks.label_runs(pred_runs(t)))


@query("c1_components_4", "fx_raster", "with recursive " + labels_cte("pred = 1", "px", near="and abs(p.y - f.y) + abs(p.x - f.x) <= 1") + C1_REGIONS)
def _(t):
    return masks.region_table(masks.label_runs(pred_runs(t), connectivity=4))


@query("a1_component_stats", "fx_raster fx_image8", "with recursive " + labels_cte("pred = 1", "px") + """,
reg as (select image_id, label, count(*) as area from px_lab group by image_id, label),
st as (select image_id, count(*) as raw_count, count(*) filter (where area >= 8) as filtered_count,
  max(area) filter (where area >= 8) as largest_area, min(area) filter (where area >= 8) as smallest_area,
  """ + he("avg(area) filter (where area >= 8)", 2) + """ as mean_area, """ + he("quantile_cont(area, 0.5) filter (where area >= 8)", 2) + """ as median_area,
  cast(sum(area) as bigint) as raw_pixels, cast(coalesce(sum(area) filter (where area >= 8), 0) as bigint) as filtered_pixels
  from reg group by image_id)
select i.image_id, coalesce(raw_count, 0) as raw_count, coalesce(filtered_count, 0) as filtered_count, largest_area, smallest_area,
  mean_area, median_area, coalesce(raw_pixels, 0) as raw_pixels, coalesce(filtered_pixels, 0) as filtered_pixels,
  case when coalesce(raw_pixels, 0) > 0 then """ + he("filtered_pixels / raw_pixels * 100.0", 2) + """ else 100.0 end as retained_percent,
  """ + he("coalesce(filtered_count, 0) / 64", 8) + """ as region_density
from fx_image8 i left join st on st.image_id = i.image_id""")
def _(t):
    regions = masks.region_table(masks.label_runs(pred_runs(t)))
    return masks.component_stats(regions, t.fx_image8, min_area=8)


@query("j19_component_errors", "fx_raster fx_image8", "with recursive " + labels_cte("gt = 1", "g") + "," + labels_cte("pred = 1", "p") + """,
gc as (select g.image_id, g.label, count(*) as area, count(p.y) as hits from g_lab g left join p_px p
  on p.image_id = g.image_id and p.y = g.y and p.x = g.x group by 1, 2 having count(*) >= 4),
pc as (select g.image_id, g.label, count(*) as area, count(p.y) as hits from p_lab g left join g_px p
  on p.image_id = g.image_id and p.y = g.y and p.x = g.x group by 1, 2 having count(*) >= 4),
ga as (select image_id, count(*) as n, count(*) filter (where hits = 0) as m from gc group by 1),
pa as (select image_id, count(*) as n, count(*) filter (where hits = 0) as m from pc group by 1)
select i.image_id, coalesce(ga.n, 0) as gt_components, coalesce(pa.n, 0) as pred_components, coalesce(ga.m, 0) as missed,
  coalesce(pa.m, 0) as false_components,
  case when coalesce(ga.n, 0) > 0 then round(coalesce(pa.n, 0) / ga.n, 6) when coalesce(pa.n, 0) = 0 then 1.0 else 999.0 end as component_ratio
from fx_image8 i left join ga on ga.image_id = i.image_id left join pa on pa.image_id = i.image_id""")
def _(t):
    gt = masks.label_runs(pred_runs(t, "gt = 1"))
    pred = masks.label_runs(pred_runs(t))
    return masks.component_errors(gt, pred, t.fx_image8, min_area=4)


@query("a41_instances", "fx_raster", "with recursive " + labels_cte("p >= 0.5", "px") + """
select l.image_id, l.label, count(*) as area, """ + he("avg(cast(r.p as decimal(18, 6)))", 6) + """ as score
from px_lab l join fx_raster r on r.image_id = l.image_id and r.y = l.y and r.x = l.x
group by l.image_id, l.label having count(*) >= 8""")
def _(t):
    return masks.instances(masks.label_runs(pred_runs(t, "p >= 0.5")), t.fx_raster, "p", min_area=8)


@query("j21_region_pixels", "fx_raster", "with recursive " + labels_cte("pred = 1", "px") + """
select l.image_id, l.y, l.x, l.label, r.p from px_lab l join fx_raster r on r.image_id = l.image_id and r.y = l.y and r.x = l.x""")
def _(t):
    return masks.region_pixels(masks.label_runs(pred_runs(t)), t.fx_raster).select("image_id", "y", "x", "label", "p")


@query("p19_binarise", "fx_raster", """
select image_id, cast(count(*) as bigint) as solar_pixels from fx_raster where p >= 0.5 group by image_id""")
def _(t):
    return masks.binarise(t.fx_raster).groupBy("image_id").agg(F.count("*").alias("solar_pixels"))


@query("runs_to_blocks", "fx_gt", "select image_id, gt_idx, y0, y1, x0, x1 from fx_gt")
def _(t):
    runs = masks.blocks_to_runs(t.fx_gt, ["image_id", "gt_idx"])
    return masks.runs_to_blocks(runs, ["image_id", "gt_idx"])
