"""Queries on tiling, blending, restoring and polygon filling."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import raster
from ..operators import masks, models, tiles
from ..functions.rounding import half_even
from .fixtures import sql_half_even as he
from .registry import query

SIZES = "sz as (select image_id, cast(200 + image_id % 900 as int) as width, cast(200 + strip * 3 as int) as height from fx_scene)"


def sizes_df(t):
    return t.fx_scene.select("image_id", (200 + F.col("image_id") % 900).cast("int").alias("width"), (200 + F.col("strip") * 3).cast("int").alias("height"))


LB = """lb0 as (select *, least({t}.0::double / width, {t}.0::double / height) as scale from {src}),
lb1 as (select *, greatest(1, cast(round_even(width * scale, 0) as int)) as scaled_w, greatest(1, cast(round_even(height * scale, 0) as int)) as scaled_h from lb0),
lb as (select *, ({t} - scaled_w) // 2 as pad_left, ({t} - scaled_h) // 2 as pad_top, {t} - scaled_w - ({t} - scaled_w) // 2 as pad_right, {t} - scaled_h - ({t} - scaled_h) // 2 as pad_bottom from lb1)"""


@query("h1_letterbox_params", "fx_scene", "with " + SIZES + "," + LB.format(t=256, src="sz") + "select image_id, round(scale, 9) as scale, scaled_w, scaled_h, pad_left, pad_top, pad_right, pad_bottom from lb")
def _(t):
    out = sizes_df(t).select("image_id", raster.letterbox(F.col("width"), F.col("height")).alias("p")).select("image_id", "p.*")
    return out.withColumn("scale", F.round("scale", 9))


@query("h2_tile_grid", "fx_scene", "with " + SIZES + """,
xs as (select image_id, unnest(case when width <= 256 then [0] else list_distinct(list_append(range(0, width - 256, 192), width - 256)) end) as tx, height from sz)
select image_id, cast(unnest(case when height <= 256 then [0] else list_distinct(list_append(range(0, height - 256, 192), height - 256)) end) as int) as ty, cast(tx as int) as tx from xs""")
def _(t):
    return tiles.tile_grid(sizes_df(t)).select("image_id", "ty", "tx")


HW = "least(1.0, greatest(0.001, (0.5 - 0.5 * cos(2.0 * pi() * ({x} + 1) / 9)) * (0.5 - 0.5 * cos(2.0 * pi() * ({y} + 1) / 9))))"


@query("h3_hann_weight", "fx_raster", "select image_id, round(sum(" + HW.format(x="x", y="y") + " * p), 6) as weighted, round(max(" + HW.format(x="x", y="y") + "), 6) as top from fx_raster group by image_id")
def _(t):
    w = raster.hann2d(F.col("x"), F.col("y"), 8, 8)
    return t.fx_raster.groupBy("image_id").agg(F.round(F.sum(w * F.col("p")), 6).alias("weighted"), F.round(F.max(w), 6).alias("top"))


@query("h4_hann_blend", "fx_raster", """with px as (select image_id // 4 as mosaic, y + ((image_id // 2) % 2) * 4 as yy, x + (image_id % 2) * 4 as xx, 1.0 / (1.0 + exp(-logit)) as q, """ + HW.format(x="x", y="y") + """ as w from fx_raster)
select mosaic as image_id, cast(yy as int) as y, cast(xx as int) as x, round(sum(q * w) / greatest(sum(w), 0.000001), 6) as p from px where xx < 11 and yy < 11 group by 1, 2, 3""")
def _(t):
    v = F.col("vec_id")
    probs = F.transform("embedding", lambda e: 1.0 / (1.0 + F.exp(-10.0 * e.cast("double"))))
    ts = t.embeddings.select(F.floor(v / 4).alias("image_id"), ((v % 2) * 4).cast("int").alias("tx"), (F.floor(v / 2) % 2 * 4).cast("int").alias("ty"),
                             F.lit(8).alias("tile_w"), F.lit(8).alias("tile_h"), probs.alias("probs"))
    images = ts.select("image_id", F.lit(11).alias("width"), F.lit(11).alias("height")).distinct()
    return tiles.hann_blend(ts, images).withColumn("p", F.round("p", 6))


@query("h5_softmax_prob", "fx_raster", "select image_id, y, x, round(1.0 / (1.0 + exp(-1.5 * logit)), 6) as p from fx_raster")
def _(t):
    return t.fx_raster.select("image_id", "y", "x", F.round(raster.softmax2(-0.5 * F.col("logit"), F.col("logit")), 6).alias("p"))


ORIG = "o as (select image_id, cast(10 + image_id % 7 as int) as width, cast(10 + image_id % 5 as int) as height from fx_image8)"


def params_df(t):
    o = t.fx_image8.select("image_id", (10 + F.col("image_id") % 7).cast("int").alias("width"), (10 + F.col("image_id") % 5).cast("int").alias("height"))
    return o.select("*", raster.letterbox(F.col("width"), F.col("height"), 8, 8).alias("p")).select("image_id", "width", "height", "p.*")


TARGETS = "t0 as (select *, unnest(range(0, width)) as x from lb), t1 as (select *, unnest(range(0, height)) as y from t0)"


@query("h6_restore_nearest", "fx_raster fx_image8", "with " + ORIG + "," + LB.format(t=8, src="o") + "," + TARGETS + """
select t.image_id, cast(t.y as int) as y, cast(t.x as int) as x from t1 t join fx_raster r on r.image_id = t.image_id and r.pred = 1
  and r.x = floor(t.x * scaled_w / width) + pad_left and r.y = floor(t.y * scaled_h / height) + pad_top""")
def _(t):
    blocks = tiles.restore_nearest(t.fx_raster.where("pred = 1").select("image_id", "y", "x"), params_df(t))
    runs = masks.blocks_to_runs(blocks, ["image_id"])
    return runs.select("image_id", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))


@query("h7_restore_bilinear", "fx_raster fx_image8", "with " + ORIG + "," + LB.format(t=8, src="o") + "," + TARGETS + """,
s as (select *, (x + 0.5) * scaled_w / width - 0.5 as fx, (y + 0.5) * scaled_h / height - 0.5 as fy from t1),
c as (select s.*, dx, dy, least(greatest(floor(fx) + dx, 0), scaled_w - 1) + pad_left as cx, least(greatest(floor(fy) + dy, 0), scaled_h - 1) + pad_top as cy,
  (case when dx = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) * (case when dy = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end) as w
  from s cross join (select unnest([0, 1]) as dx) a cross join (select unnest([0, 1]) as dy) b)
select c.image_id, cast(c.y as int) as y, cast(c.x as int) as x, """ + he("least(1.0::double, greatest(0.0::double, cast(sum(cast(w * r.p as decimal(28, 12))) as double)))", 5) + """ as p from c join fx_raster r on r.image_id = c.image_id and r.x = c.cx and r.y = c.cy group by 1, 2, 3""")
def _(t):
    return tiles.restore_bilinear(t.fx_raster.select("image_id", "y", "x", "p"), params_df(t)).withColumn("p", half_even("p", 5))


@query("h8_polygon_to_runs", "fx_gt", """with r as (select *, unnest(range(y0, y1)) as y from fx_gt)
select image_id, gt_idx, cast(y as int) as y, x0, cast(case when y - y0 < (y1 - y0) // 4 then x1 - (x1 - x0) // 4 else x1 end as int) as x1 from r""")
def _(t):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    a, b = F.floor(w / 4), F.floor(h / 4)
    z = F.lit(0)
    pts = [(z, z), (w - a, z), (w - a, b), (w, b), (w, h), (z, h)]
    ring = F.array(*[v.cast("double") for x, y in pts for v in (F.col("x0") + x, F.col("y0") + y)])
    polys = t.fx_gt.select("image_id", "gt_idx", ring.alias("ring"))
    return tiles.polygon_to_runs(polys, t.fx_scene, ["image_id", "gt_idx"])


@query("p6_valid_annotations", "fx_gt", "select image_id, gt_idx, 1 as polygons from fx_gt where area >= 900 and not (x1 - x0 > 60)")
def _(t):
    from ..operators.catalogue import valid_annotations

    short = F.array(*[F.lit(0.0)] * 4)
    ring = F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")])
    ann = t.fx_gt.select("image_id", "gt_idx", F.greatest(F.col("area") - 899, F.lit(0)).alias("area"), (F.col("x1") - F.col("x0") > 60).cast("int").alias("iscrowd"), F.array(ring, short).alias("segmentation"))
    return valid_annotations(ann).select("image_id", "gt_idx", F.size("segmentation").alias("polygons"))


@query("p5_keep_area", "fx_gt", "select image_id, gt_idx, area from fx_gt where area >= 1500")
def _(t):
    return masks.keep_area(t.fx_gt, 1500).select("image_id", "gt_idx", "area")


@query("j26_tile_place", "fx_det", """with g as (select *, cast(pred_idx % 4 as int) as tile_id from fx_det), p as (select *, (tile_id % 2) * 192 as tx, (tile_id // 2) * 192 as ty from g),
q as (select model, image_id, pred_idx, least(640, x0 + tx) as x0, least(640, x1 + tx) as x1, least(640, y0 + ty) as y0, least(640, y1 + ty) as y1 from p)
select * from q where x1 > x0 and y1 > y0""")
def _(t):
    det = t.fx_det.withColumn("tile_id", (F.col("pred_idx") % 4).cast("int"))
    grid = t.fx_scene.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tile_id"))
    grid = grid.withColumns({"tx": (F.col("tile_id") % 2 * 192).cast("int"), "ty": (F.floor(F.col("tile_id") / 2) * 192).cast("int")})
    return tiles.tile_place(det, grid).select("model", "image_id", "pred_idx", "x0", "x1", "y0", "y1")


@query("m5_batch_score", "fx_raster", "select image_id, y, x, round(1.0 / (1.0 + exp(-logit)), 6) as score from fx_raster")
def _(t):
    def score(pdf):
        return pdf[["image_id", "y", "x"]].assign(score=1.0 / (1.0 + np.exp(-pdf["logit"].to_numpy())))

    out = models.batch_score(t.fx_raster.select("image_id", "y", "x", "logit"), score, "image_id bigint, y int, x int, score double", batch=4096)
    return out.withColumn("score", F.round("score", 6))
