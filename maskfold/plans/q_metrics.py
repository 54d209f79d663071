"""Queries on pixel metrics and their summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images, masks, metrics, sweep
from .fixtures import MODELS
from .materialise import materialise
from .ordering import running
from .q_masks import CONFUSION_CTES, ROWS, confusion_df
from .fixtures import sql_half_even as he
from .registry import query

VIEWS = "fx_gt fx_det fx_scene"
E = "0.0000001"
FG = CONFUSION_CTES + f""",
fg as (select *, 2.0 * tp / (2.0 * tp + fp + fn + {E}) as d0,
    case when gt_pixels = 0 and pred_pixels = 0 then 1.0 else 2.0 * tp / (2.0 * tp + fp + fn + {E}) end as dice,
    case when gt_pixels = 0 and pred_pixels = 0 then 1.0 else tp / (tp + fp + fn + {E}) end as iou,
    case when gt_pixels = 0 and pred_pixels = 0 then 1.0 when pred_pixels > 0 then tp / (tp + fp + {E}) else 0.0 end as precision,
    case when gt_pixels = 0 and pred_pixels = 0 then 1.0 when gt_pixels > 0 then tp / (tp + fn + {E}) else 0.0 end as recall,
    (tp + tn) / total_pixels as accuracy, case when tn + fp > 0 then fp / (tn + fp + {E}) else 0.0 end as fpr,
    case when gt_pixels > 0 then fn / (gt_pixels + {E}) else 0.0 end as fnr from conf),
fgs as (select fg.*, s.split, s.category, s.has_solar from fg join fx_scene s on s.image_id = fg.image_id)
"""


def micro(by: str, where: str = "true", src: str = "fgs", rnd: str = "{}") -> str:
    r = {m: rnd.format(m) for m in ("dice", "iou", "precision", "recall")}
    return f"""select {by}, count(*) as images, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(tn) as bigint) as tn,
  round(avg({r['dice']}), 6) as mean_dice, round(avg({r['iou']}), 6) as mean_iou, round(avg({r['precision']}), 6) as mean_precision, round(avg({r['recall']}), 6) as mean_recall,
  round(avg(accuracy), 6) as mean_accuracy, round(avg(fpr), 6) as mean_fpr, round(avg(fnr), 6) as mean_fnr, round(min({r['dice']}), 6) as min_dice, round(max({r['dice']}), 6) as max_dice,
  round(stddev_pop({r['dice']}), 6) as std_dice, round(min({r['iou']}), 6) as min_iou, round(max({r['iou']}), 6) as max_iou,
  round(2.0 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn) + {E}), 6) as micro_dice, round(sum(tp) / (sum(tp) + sum(fp) + sum(fn) + {E}), 6) as micro_iou,
  round(sum(tp) / (sum(tp) + sum(fp) + {E}), 6) as micro_precision, round(sum(tp) / (sum(tp) + sum(fn) + {E}), 6) as micro_recall
  MEDIANS from {src} where {where} group by {by}"""


def med(text: str, rnd: str = "{}") -> str:
    return text.replace("MEDIANS", "".join(f", round(quantile_cont({rnd.format(m)}, 0.5), 6) as median_{m}" for m in ("dice", "iou", "precision", "recall")) + " MEDIANS")


TWO_CLASS = f""", round(avg((dice + 2.0 * tn / (2.0 * tn + fp + fn + {E})) / 2.0), 6) as macro_mean_dice, round(avg((iou + tn / (tn + fn + fp + {E})) / 2.0), 6) as macro_mean_iou,
  round(avg((precision + tn / (tn + fn + {E})) / 2.0), 6) as macro_mean_precision, round(avg((recall + tn / (tn + fp + {E})) / 2.0), 6) as macro_mean_recall"""


def metrics_df(t):
    scene = t.fx_scene.select("image_id", "split", "category", "has_solar")
    return metrics.fg_metrics(confusion_df(t)).join(scene, "image_id")


R6 = ("dice", "iou", "precision", "recall", "accuracy", "fpr", "fnr")


@query("a3_fg_metrics", VIEWS, "with " + FG + "select model, image_id, " + ", ".join(f"round({m}, 6) as {m}" for m in R6) + " from fg")
def _(t):
    return metrics.fg_metrics(confusion_df(t)).select("model", "image_id", *[F.round(m, 6).alias(m) for m in R6])


@query("a4_two_class_macro", VIEWS, "with " + FG + f"""select model, count(*) as images,
  round(avg((dice + 2.0 * tn / (2.0 * tn + fp + fn + {E})) / 2.0), 6) as macro_dice, round(avg((iou + tn / (tn + fn + fp + {E})) / 2.0), 6) as macro_iou,
  round(avg((precision + tn / (tn + fn + {E})) / 2.0), 6) as macro_precision, round(avg((recall + tn / (tn + fp + {E})) / 2.0), 6) as macro_recall from fg group by model""")
def _(t):
    m = metrics.two_class_macro(metrics.fg_metrics(confusion_df(t)))
    return m.groupBy("model").agg(F.count("*").alias("images"), *[F.round(F.avg(f"macro_{c}"), 6).alias(f"macro_{c}") for c in metrics.HEADLINE])


@query("a5_micro_macro", VIEWS, "with " + FG + med(micro("model")).replace("MEDIANS", TWO_CLASS))
def _(t):
    return metrics.micro_macro(metrics_df(t), ["model"], two_class=True)


@query("a5_micro_macro_pre_round", VIEWS, "with " + FG + micro("model", rnd="round({}, 4)").replace("MEDIANS", ""))
def _(t):
    return metrics.micro_macro(metrics_df(t), ["model"], pre_round=4, median=False)


@query("a6_positive_only_macro", VIEWS, "with " + FG + med(micro("model", "gt_pixels > 0")).replace("MEDIANS", ""))
def _(t):
    return metrics.micro_macro(metrics_df(t), ["model"], where=F.col("gt_pixels") > 0)


DIST = " union all ".join(
    f"select model, '{m}' as metric, {m}::double as v from fg" for m in ("dice", "iou", "pred_pixels")
)


@query("a7_distribution", VIEWS, "with " + FG + f""", d as ({DIST})
select model, metric, count(v) as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(min(v), 6) as min, round(max(v), 6) as max,
  round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.75), 6) as p75 from d group by 1, 2""")
def _(t):
    return metrics.distribution(metrics.fg_metrics(confusion_df(t)), ["dice", "iou", "pred_pixels"], ["model"])


@query("a8_generalisation_gap", VIEWS, "with " + FG + ", s as (" + micro("model, split").replace("MEDIANS", "") + """)
select a.model, a.micro_dice as train_micro_dice, b.micro_dice as test_micro_dice, round(a.micro_dice - b.micro_dice, 6) as gap_micro_dice,
  a.mean_iou as train_mean_iou, b.mean_iou as test_mean_iou, round(a.mean_iou - b.mean_iou, 6) as gap_mean_iou
from s a join s b on a.model = b.model and a.split = 'train' and b.split = 'test'""")
def _(t):
    s = metrics.micro_macro(metrics_df(t), ["model", "split"], median=False)
    return metrics.generalisation_gap(s, ["micro_dice", "mean_iou"])


CAT = micro("rollup(model, category)").replace("MEDIANS", "").replace("select rollup(model, category)", "select model, category, cast(grouping_id(model, category) as bigint) as level")


@query("a9_per_category", VIEWS, "with " + FG + CAT)
def _(t):
    return metrics.micro_macro(metrics_df(t), ["model", "category"], rollup=True)


@query("a10_model_aggregates", VIEWS, "with " + FG + """, sub as (select *, case when has_solar = 1 then 'positive_annotated' else 'negative_control' end as subset from fgs) """ + micro("model, subset", src="sub").replace("MEDIANS", ""))
def _(t):
    m = metrics_df(t).withColumn("subset", F.when(F.col("has_solar") == 1, "positive_annotated").otherwise("negative_control"))
    cols = ["tp", "fp", "fn", "tn", "dice", "iou", "precision", "recall", "accuracy", "fpr", "fnr"]
    wide = m.groupBy("image_id", "subset").agg(*[F.max(F.when(F.col("model") == x, F.col(c))).alias(f"{x}_{c}") for x in MODELS for c in cols])
    return metrics.micro_macro(metrics.wide_to_long(wide, MODELS, cols, ["image_id", "subset"]), ["model", "subset"], median=False)


@query("a11_harmonic", VIEWS, "with " + FG + f""", s as (select model, 2.0 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn) + {E}) as d, split from fgs group by model, split)
select a.model, round(case when a.d <= 0 or b.d <= 0 then 0.0 else 2.0 * a.d * b.d / (a.d + b.d + {E}) end, 4) as harmonic_dice
from s a join s b on a.model = b.model and a.split = 'val' and b.split = 'test'""")
def _(t):
    s = metrics_df(t).groupBy("model").agg(*[
        (2.0 * F.sum(F.when(F.col("split") == sp, F.col("tp"))) / (2.0 * F.sum(F.when(F.col("split") == sp, F.col("tp")))
         + F.sum(F.when(F.col("split") == sp, F.col("fp"))) + F.sum(F.when(F.col("split") == sp, F.col("fn"))) + metrics.EPS)).alias(sp)
        for sp in ("val", "test")])
    return s.select("model", F.round(metrics.harmonic(F.col("val"), F.col("test")), 4).alias("harmonic_dice"))


@query("a12_neg_pixel_rate", VIEWS, "with " + FG + """select model, count(*) as images, cast(sum(fp) as bigint) as fp, round(sum(fp) / sum(total_pixels), 6) as fp_pixel_rate
from fgs where has_solar = 0 group by model""")
def _(t):
    return metrics.negative_pixel_rate(confusion_df(t), t.fx_scene)


def _compare() -> str:
    cells = ", ".join(f"round(max({c}) filter (where model = '{m}'), 4) as {m}_{c}" for m in MODELS for c in metrics.HEADLINE)
    diffs = ", ".join(f"round(max(dice) filter (where model = '{m}') - max(dice) filter (where model = 'm0'), 4) as {m}_minus_m0_dice" for m in ("m1", "m2"))
    return f"select image_id, {cells}, {diffs} from fg group by image_id"


@query("j20_model_compare", VIEWS, "with " + FG + _compare())
def _(t):
    return metrics.model_compare(metrics.fg_metrics(confusion_df(t)), MODELS, "m0")


W4 = """, c as (select image_id, category, round(max(dice) filter (where model = 'm1') - max(dice) filter (where model = 'm0'), 4) as dice_change from fgs group by 1, 2),
r as (select *, row_number() over (order by dice_change desc, image_id) - 1 as pos, count(*) over () as n, row_number() over (partition by category order by image_id) as cpos from c)
select image_id, category, dice_change, case when pos = 0 then 'best' when pos = n // 2 then 'middle' else 'worst' end as pick from r where pos in (0, n // 2, n - 1)
union all select image_id, category, dice_change, 'category_first' from r where cpos = 1"""


@query("w4_representatives", VIEWS, "with " + FG + W4)
def _(t):
    cmp = metrics.model_compare(metrics.fg_metrics(confusion_df(t)), MODELS, "m0").select("image_id", F.col("m1_minus_m0_dice").alias("dice_change"))
    cmp = materialise(cmp.join(t.fx_scene.select("image_id", "category"), "image_id").select("image_id", "category", "dice_change"), "changes")
    placed = running(cmp, [-F.col("dice_change"), F.col("image_id")])
    n = placed.agg(F.count("*").alias("n"))  # one row
    at = F.col("pos") - 1
    picks = placed.join(F.broadcast(n)).withColumn(
        "pick", F.when(at == 0, "best").when(at == F.floor(F.col("n") / 2), "middle").when(at == F.col("n") - 1, "worst")
    ).where("pick is not null").select("image_id", "category", "dice_change", "pick")
    first = cmp.groupBy("category").agg(F.min_by(F.struct("image_id", "dice_change"), "image_id").alias("f")).select(
        "f.image_id", "category", "f.dice_change", F.lit("category_first").alias("pick"))
    return picks.unionByName(first)


@query("a42_coverage_distribution", "fx_gt fx_scene", "with " + ROWS.format(keys="image_id", src="fx_gt") + """,
c as (select s.image_id, """ + he("coalesce(area, 0) / (width * height) * 100.0", 4) + """ as v from fx_scene s left join covered c on c.image_id = s.image_id)
select count(*) as images, round(avg(v), 4) as mean, round(avg(case when v <= 3.0 then 1.0 else 0.0 end), 6) as small_share,
  """ + he("quantile_cont(v, 0.25)", 4) + """ as p25, """ + he("quantile_cont(v, 0.5)", 4) + """ as median, """ + he("quantile_cont(v, 0.75)", 4) + """ as p75 from c""")
def _(t):
    return metrics.coverage_distribution(masks.coverage(images.covered_area(t.fx_gt), t.fx_scene))


@query("a43_annotation_size_share", "fx_gt fx_scene", """
select count(*) as annotations, round(avg(case when pct < 0.5 then 1.0 else 0.0 end), 6) as below_0_5, round(avg(case when pct < 1.0 then 1.0 else 0.0 end), 6) as below_1_0,
  round(avg(case when pct < 2.0 then 1.0 else 0.0 end), 6) as below_2_0, round(avg(case when pct < 5.0 then 1.0 else 0.0 end), 6) as below_5_0
from (select g.area / (s.width * s.height) * 100.0 as pct from fx_gt g join fx_scene s on s.image_id = g.image_id) q""")
def _(t):
    return metrics.size_share(t.fx_gt.join(t.fx_scene.select("image_id", "width", "height"), "image_id"))


@query("p21_density_tier", "fx_gt fx_scene", """
select tier, count(*) as images, cast(sum(n) as bigint) as panels from (
  select s.image_id, count(g.gt_idx) as n, case when count(g.gt_idx) >= 40 then 'Very High' when count(g.gt_idx) >= 30 then 'High' when count(g.gt_idx) >= 20 then 'High-Medium'
    when count(g.gt_idx) >= 15 then 'Medium' when count(g.gt_idx) >= 10 then 'Median' when count(g.gt_idx) >= 6 then 'Moderate-Low' when count(g.gt_idx) >= 3 then 'Low'
    when count(g.gt_idx) >= 1 then 'Minimal' else 'Zero-Solar Control' end as tier
  from fx_scene s left join fx_gt g on g.image_id = s.image_id group by s.image_id) q group by tier""")
def _(t):
    n = t.fx_gt.groupBy("image_id").agg(F.count("*").alias("c"))
    tiers = t.fx_scene.select("image_id").join(n, "image_id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return tiers.groupBy(metrics.density_tier(F.col("c")).alias("tier")).agg(F.count("*").alias("images"), F.sum("c").alias("panels"))


@query("a16_threshold_sweep_px", "fx_raster", f"""with th as (select unnest([0.2::double, 0.3, 0.4, 0.5, 0.6]) as threshold),
i as (select th.threshold, r.image_id, sum(case when p >= threshold and gt = 1 then 1 else 0 end) as tp, sum(case when p >= threshold and gt = 0 then 1 else 0 end) as fp,
  sum(case when p < threshold and gt = 1 then 1 else 0 end) as fn, sum(case when p < threshold and gt = 0 then 1 else 0 end) as tn from fx_raster r cross join th group by 1, 2),
d as (select *, case when tp + fp = 0 then 0.0 else 2.0 * tp / (2.0 * tp + fp + fn + {E}) end as dice, case when tp + fp = 0 then 0.0 else tp / (tp + fp + fn + {E}) end as iou,
  case when tp + fp = 0 then 0.0 else tp / (tp + fp + {E}) end as pr, case when tp + fp = 0 then 0.0 else tp / (tp + fn + {E}) end as re from i)
select threshold, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(tn) as bigint) as tn,
  round(2.0 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn) + {E}), 4) as micro_dice, round(sum(tp) / (sum(tp) + sum(fp) + sum(fn) + {E}), 4) as micro_iou,
  round(sum(tp) / (sum(tp) + sum(fp) + {E}), 4) as micro_precision, round(sum(tp) / (sum(tp) + sum(fn) + {E}), 4) as micro_recall,
  round((sum(tp) + sum(tn)) / (sum(tp) + sum(tn) + sum(fp) + sum(fn)), 4) as micro_accuracy,
  round(avg(dice) filter (where tp + fn > 0), 4) as mean_dice, round(avg(iou) filter (where tp + fn > 0), 4) as mean_iou,
  round(quantile_cont(dice, 0.5) filter (where tp + fn > 0), 4) as median_dice, round(quantile_cont(iou, 0.5) filter (where tp + fn > 0), 4) as median_iou,
  round(avg(pr) filter (where tp + fn > 0), 4) as mean_precision, round(avg(re) filter (where tp + fn > 0), 4) as mean_recall from d group by threshold""")
def _(t):
    return sweep.sweep_pixels(t.fx_raster, [0.2, 0.3, 0.4, 0.5, 0.6])


@query("a40_class_metrics", "fx_raster", f"""with c as (select cls, sum(case when gt = cls and pred = cls then 1 else 0 end) as tp, sum(case when gt <> cls and pred = cls then 1 else 0 end) as fp,
  sum(case when gt = cls and pred <> cls then 1 else 0 end) as fn, sum(case when gt = pred then 1 else 0 end) as ok, count(*) as n
  from fx_raster cross join (select unnest([0, 1]) as cls) k group by cls),
d as (select *, tp / (tp + fp + {E}) as p, tp / (tp + fn + {E}) as r from c)
select round(max(ok / n), 6) as accuracy, round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(2 * p * r / (p + r + {E})), 6) as f1,
  round(avg(tp / (tp + fp + fn + {E})), 6) as iou, round(avg(2 * tp / (2 * tp + fp + fn + {E})), 6) as dice, round(1.0 - avg(2 * tp / (2 * tp + fp + fn + {E})), 6) as dice_loss from d""")
def _(t):
    return metrics.class_metrics(t.fx_raster, [0, 1])


@query("a46_dice_loss", "fx_raster", """select round(1.0 - ((2.0 * sum((1 - p) * (1 - gt)) + 1.0) / (sum((1 - p) + (1 - gt)) + 1.0) + (2.0 * sum(p * gt) + 1.0) / (sum(p + gt) + 1.0)) / 2.0, 6) as dice_loss from fx_raster""")
def _(t):
    return metrics.dice_loss(t.fx_raster)
