"""Queries on candidate features, labels, mining, rankings and training logs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, images
from .materialise import materialise
from ..functions.parsing import fill_median, keep_labels, numeric_coerce
from .q_matching import MATCH, MAXIOU, VIEWS, diagnosis_df, matched_df
from .registry import query

LABELS = (0, 1, 2, 3)


@query("h19_shape_features", "fx_det fx_scene", """select d.model, d.image_id, d.pred_idx, cast(d.x1 - d.x0 as double) as bbox_width, cast(d.y1 - d.y0 as double) as bbox_height, cast((d.x1 - d.x0) * (d.y1 - d.y0) as double) as bbox_area_px,
  round((d.x1 - d.x0) / (d.y1 - d.y0), 6) as aspect_ratio, round(d.area / ((d.x1 - d.x0) * (d.y1 - d.y0)), 6) as rectangularity, round(d.area / (width * height), 14) as relative_mask_area,
  round((d.x0 + d.x1) / 2.0::double / width, 9) as center_x_norm, round((d.y0 + d.y1) / 2.0::double / height, 9) as center_y_norm,
  round(least((d.x0 + d.x1) / 2.0::double / width, 1.0 - (d.x0 + d.x1) / 2.0::double / width, (d.y0 + d.y1) / 2.0::double / height, 1.0 - (d.y0 + d.y1) / 2.0::double / height), 9) as edge_distance_norm
from fx_det d join fx_scene s on s.image_id = d.image_id""")
def _(t):
    out = features.shape_features(t.fx_det, t.fx_scene)
    return out.drop("score_pct", "x0", "y0", "x1", "y1", "area")


@query("h20_outline_features", "fx_gt", """with o as (select image_id, gt_idx, x1 - x0 as w, y1 - y0 as h, floor((x1 - x0) / 4) as a, floor((y1 - y0) / 4) as b from fx_gt),
p as (select *, w * h - a * b as area, 2.0 * (w + h) as per, w * h - a * b / 2.0 as hull from o)
select image_id, gt_idx, round(cast(area as double), 6) as outline_area, round(cast(per as double), 6) as perimeter, round(cast(hull as double), 6) as hull_area, round(4 * pi() * area / (per * per), 6) as compactness, round(area / hull, 6) as solidity from p""")
def _(t):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    a, b = F.floor(w / 4), F.floor(h / 4)

    def pt(x, y):
        return F.struct((F.col("x0") + x).cast("double").alias("x"), (F.col("y0") + y).cast("double").alias("y"))

    z = F.lit(0)
    # a box with one corner cut out: not convex
    ring = F.array(pt(z, z), pt(w - a, z), pt(w - a, b), pt(w, b), pt(w, h), pt(z, h))
    return features.outline_features(t.fx_gt.select("image_id", "gt_idx", ring.alias("vertices")), ["image_id", "gt_idx"])


@query("j17_neighbour_count", "fx_det", """select d.model, d.image_id, d.pred_idx, count(o.pred_idx) as neighbour_count from fx_det d left join fx_det o on o.model = d.model and o.image_id = d.image_id
  and (power((d.x0 + d.x1) - (o.x0 + o.x1), 2) + power((d.y0 + d.y1) - (o.y0 + o.y1), 2)) between 1 and 40000 group by 1, 2, 3""")
def _(t):
    return images.neighbour_count(t.fx_det).select("model", "image_id", "pred_idx", "neighbour_count")


SC = "st as (select image_id, pred_idx as stored_idx, score_pct / 100 as score, x0, y0, x1, y1 from fx_det where model = 'm0'), cu as (select image_id, pred_idx, score_pct / 100 as score, x0, y0, x1, y1 from fx_det where model = 'm1')"


def stored_current(t):
    d = t.fx_det.withColumn("score", F.col("score_pct") / 100)
    return d.where("model = 'm0'").withColumnRenamed("pred_idx", "stored_idx"), d.where("model = 'm1'")


@query("j11_rematch_nearest", "fx_det", "with " + SC + """, p as (select s.image_id, s.stored_idx, c.pred_idx, (abs(s.x0 - c.x0) + abs(s.y0 - c.y0) + abs(s.x1 - c.x1) + abs(s.y1 - c.y1)) / 4 + 50 * abs(s.score - c.score) as d from st s join cu c on c.image_id = s.image_id),
r as (select *, row_number() over (partition by image_id, stored_idx order by round(d, 6), pred_idx) as rn from p)
select image_id, stored_idx, pred_idx, round(d, 6) as distance from r where rn = 1""")
def _(t):
    return images.rematch_nearest(*stored_current(t)).select("image_id", "stored_idx", "pred_idx", F.round("distance", 6).alias("distance"))


@query("j12_rematch_tolerance", "fx_det", "with " + SC + """, di as (select s.image_id, s.stored_idx from st s join cu c on c.image_id = s.image_id and c.pred_idx = s.stored_idx and abs(c.score - s.score) <= 0.002),
ne as (select s.image_id, s.stored_idx, c.pred_idx, row_number() over (partition by s.image_id, s.stored_idx order by round(abs(c.score - s.score), 9), c.pred_idx) as rn from st s join cu c on c.image_id = s.image_id and round(abs(c.score - s.score), 9) <= 0.01)
select s.image_id, s.stored_idx, case when di.stored_idx is not null then di.stored_idx else ne.pred_idx end as pred_idx, case when di.stored_idx is not null then 'same_index' when ne.pred_idx is not null then 'closest_score' else 'unmatched' end as how
from st s left join di on di.image_id = s.image_id and di.stored_idx = s.stored_idx left join ne on ne.image_id = s.image_id and ne.stored_idx = s.stored_idx and ne.rn = 1""")
def _(t):
    s, c = stored_current(t)
    return features.rematch_tolerance(s.select("image_id", "stored_idx", "score"), c.select("image_id", "pred_idx", "score"))


@query("a26_label_distribution", "fx_labelled", "select label, count(*) as n, round(count(*) / (select count(*) from fx_labelled) * 100.0, 2) as percent from fx_labelled group by label")
def _(t):
    return features.label_distribution(t.fx_labelled, "label")


FEATS = ("w", "h", "area", "score_pct", "x0")
LONG = " union all ".join(f"select label, '{f}' as feature, cast({f} as double) as v from fx_labelled" for f in FEATS)


@query("a27_feature_summary", "fx_labelled", f"with l as ({LONG}) select label, feature, count(v) as n, round(avg(v), 4) as mean, round(quantile_cont(v, 0.5), 4) as median from l group by 1, 2")
def _(t):
    return features.feature_summary(t.fx_labelled, FEATS, "label")


@query("a27_iou_by_category", VIEWS, MAXIOU + "select diagnostic_category, count(*) as n, round(avg(max_gt_iou), 4) as mean_gt_iou, round(avg(max_matched_iou), 4) as mean_matched_iou, round(avg(score_pct) / 100, 4) as mean_score from diag group by 1")
def _(t):
    return diagnosis_df(t).groupBy("diagnostic_category").agg(F.count("*").alias("n"), F.round(F.avg("max_gt_iou"), 4).alias("mean_gt_iou"),
                                                            F.round(F.avg("max_matched_iou"), 4).alias("mean_matched_iou"), F.round(F.avg("score_pct") / 100, 4).alias("mean_score"))


@query("a28_score_summary", "fx_labelled", "select label, count(*) as n, round(min(score_pct / 100), 4) as min, round(max(score_pct / 100), 4) as max, round(avg(score_pct / 100), 6) as mean, round(quantile_cont(score_pct / 100, 0.5), 4) as median, round(stddev_samp(score_pct / 100), 6) as std from fx_labelled group by label")
def _(t):
    return features.score_summary(t.fx_labelled, "label")


# label 3 stands for an ambiguous answer and is put aside before ranking
AUC = f"""with l as (select * from ({LONG}) q where label in (0, 1, 2)), r as (select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0 as rk from l),
a as (select k.lab as target_label, feature, count(*) filter (where label = k.lab) as n1, count(*) filter (where label <> k.lab) as n0, sum(rk) filter (where label = k.lab) as s from r cross join (select unnest([0, 1, 2]) as lab) k group by 1, 2),
u as (select target_label, feature, (s - n1 * (n1 + 1) / 2.0) / (n1 * n0) as auc from a where n1 > 0 and n0 > 0),
v as (select cast(target_label as int) as target_label, feature, round(auc, 4) as auc, round(greatest(auc, 1 - auc), 4) as separability from u)
"""


def auc_df(t):
    return features.feature_auc(keep_labels(t.fx_labelled, (0, 1, 2)), FEATS, (0, 1, 2))


@query("a29_feature_auc", "fx_labelled", AUC + "select * from v")
def _(t):
    return auc_df(t)


@query("t5_auc_top", "fx_labelled", AUC + "select target_label, feature, separability, rank from (select *, cast(row_number() over (partition by target_label order by separability desc, feature) as int) as rank from v) q where rank <= 3")
def _(t):
    return features.top_per(auc_df(t), ["target_label"], [F.col("separability").desc(), F.col("feature")], 3).select("target_label", "feature", "separability", "rank")


@query("p7_keep_labels", "fx_labelled", "select label, count(*) as n from fx_labelled where label in (0, 1, 2) group by 1")
def _(t):
    return keep_labels(t.fx_labelled, [0, 1, 2]).groupBy("label").agg(F.count("*").alias("n"))


@query("p20_numeric_coerce", "fx_history", """with c as (select seq, case when seq % 7 = 0 then null else value end as v from fx_history),
r as (select v, row_number() over (order by v) as k, count(*) over () as n from c where v is not null),
m as (select min(v) as lo, max(v) as hi from r where k in ((n + 1) // 2, n // 2 + 1))
select seq, coalesce(v, lo + (hi - lo) * 0.5::double) as v from c cross join m""")
def _(t):
    raw = t.fx_history.select("seq", F.when(F.col("seq") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("v"))
    return fill_median(materialise(numeric_coerce(raw, ["v"]), "coerced"), ["v"])


CM = ", ".join(f"count(*) filter (where predicted = {c}) as pred_{c}" for c in LABELS)


@query("a37_confusion_matrix", "fx_labelled", f"select label, {CM} from fx_labelled group by label")
def _(t):
    return features.confusion_matrix(t.fx_labelled, LABELS)


REP = """, k as (select unnest([0, 1, 2, 3]) as cls),
r as (select {g} k.cls, count(*) filter (where label = k.cls and predicted = k.cls) as tp, count(*) filter (where predicted = k.cls) as np, count(*) filter (where label = k.cls) as support from src cross join k group by {g} k.cls),
q as (select *, case when np > 0 then tp / np else 0.0 end as p, case when support > 0 then tp / support else 0.0 end as rc from r),
f as (select *, case when p + rc > 0 then 2 * p * rc / (p + rc) else 0.0 end as f1 from q)
"""


@query("a38_class_report", "fx_labelled", "with src as (select * from fx_labelled)" + REP.format(g="") + "select cast(cls as int) as cls, support, tp, np, round(p, 6) as precision, round(rc, 6) as recall, round(f1, 6) as f1 from f")
def _(t):
    r = features.class_report(t.fx_labelled, LABELS)
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("a38_classification_report", "fx_labelled", "with src as (select * from fx_labelled)" + REP.format(g="fold,") + """select fold, cast(sum(support) as bigint) as n, round(sum(tp) / sum(support), 6) as accuracy, round(avg(rc) filter (where support > 0), 6) as balanced_accuracy,
  round(avg(p), 6) as macro_precision, round(avg(rc), 6) as macro_recall, round(avg(f1), 6) as macro_f1 from f where support > 0 or np > 0 group by fold""")
def _(t):
    return features.classification_report(t.fx_labelled, LABELS, ["fold"])


@query("t6_rank_models", "fx_labelled", "with src as (select * from fx_labelled)" + REP.format(g="fold,") + """, m as (select fold, round(avg(f1), 6) as macro_f1 from f group by fold)
select fold as model, macro_f1, cast(row_number() over (order by macro_f1 desc, fold) as int) as rank from m""")
def _(t):
    r = features.classification_report(t.fx_labelled, LABELS, ["fold"]).select(F.col("fold").alias("model"), "macro_f1")
    return features.rank_models(r, "macro_f1")


HN = """with h as (select s.image_id, s.filename, count(d.pred_idx) as raw, count(d.pred_idx) filter (where score_pct >= 75) as hi, coalesce(max(score_pct), 0) / 100 as mx,
  round(coalesce(sum(score_pct) / count(d.pred_idx) / 100, 0.0), 6) as ma, round(coalesce(sum(score_pct) filter (where score_pct >= 75) / count(d.pred_idx) filter (where score_pct >= 75) / 100, 0.0), 6) as mh,
  round(coalesce(sum(score_pct) filter (where score_pct >= 75), 0) / 100, 6) as pr from fx_scene s left join fx_det d on d.image_id = s.image_id and d.model = 'm0' where s.has_solar = 0 and s.split = 'train' group by 1, 2),
hn as (select image_id, filename, raw as raw_prediction_count, hi as high_confidence_prediction_count, mx as max_confidence, ma as mean_confidence_all, mh as mean_confidence_high, pr as priority_score, case when hi > 0 then 1 else 0 end as is_hard_negative from h)
"""


def hn_df(t):
    neg = t.fx_scene.where("has_solar = 0 and split = 'train'").select("image_id", "filename")
    return features.hard_negatives(t.fx_det.where("model = 'm0'"), neg)


@query("a35_hard_negatives", "fx_scene fx_det", HN + "select * from hn")
def _(t):
    return hn_df(t)


@query("a36_mining_summary", "fx_scene fx_det", HN + "select count(*) as images, cast(sum(is_hard_negative) as bigint) as hard_images, round(avg(is_hard_negative) * 100.0, 6) as hard_rate_percent, cast(sum(high_confidence_prediction_count) as bigint) as high_predictions, round(avg(high_confidence_prediction_count), 6) as mean_high_per_image from hn")
def _(t):
    return features.mining_summary(hn_df(t))


@query("t3_rank_hard_negatives", "fx_scene fx_det", HN + "select image_id, priority_score, max_confidence, high_confidence_prediction_count from hn order by is_hard_negative desc, priority_score desc, max_confidence desc, high_confidence_prediction_count desc, image_id limit 20")
def _(t):
    order = [F.col(c).desc() for c in ("is_hard_negative", "priority_score", "max_confidence", "high_confidence_prediction_count")]
    return hn_df(t).orderBy(*order, "image_id").limit(20).select("image_id", "priority_score", "max_confidence", "high_confidence_prediction_count")


@query("t4_topk_per_label", VIEWS, MATCH + """select model, classification, image_id, pred_idx, score_pct, rank from (select model, case when is_tp = 1 then 'TP' else 'FP' end as classification, image_id, pred_idx, score_pct,
  cast(row_number() over (partition by model, is_tp order by score_pct desc, image_id, pred_idx) as int) as rank from m) q where rank <= 10""")
def _(t):
    m = matched_df(t).withColumn("classification", F.when(F.col("is_tp") == 1, "TP").otherwise("FP"))
    return features.top_per(m, ["model", "classification"], [F.col("score_pct").desc(), F.col("image_id"), F.col("pred_idx")], 10).select("model", "classification", "image_id", "pred_idx", "score_pct", "rank")


@query("t4_topk_per_category", VIEWS, MAXIOU + "select diagnostic_category, model, image_id, pred_idx, score_pct from (select *, row_number() over (partition by diagnostic_category order by score_pct desc, model, image_id, pred_idx) as rn from diag) q where rn <= 6")
def _(t):
    order = [F.col("score_pct").desc(), F.col("model"), F.col("image_id"), F.col("pred_idx")]
    return features.top_per(diagnosis_df(t), ["diagnostic_category"], order, 6).select("diagnostic_category", "model", "image_id", "pred_idx", "score_pct")


PR = """, tot as (select count(*) as g from fx_gt),
c as (select model, image_id, pred_idx, is_tp, row_number() over w as rank, cast(sum(is_tp) over w as bigint) as tp_cum from m window w as (partition by model order by score_pct desc, image_id, pred_idx rows between unbounded preceding and current row)),
e as (select *, max(tp_cum / rank) over (partition by model order by rank desc rows between unbounded preceding and current row) as env from c)
"""


def gt_total(t):
    return t.fx_gt.agg(F.count("*").alias("gt_total"))


def curve_df(t):
    return features.pr_curve(matched_df(t), gt_total(t))


@query("w5_pr_cumulative", VIEWS, MATCH + PR + "select model, image_id, pred_idx, rank, tp_cum, rank - tp_cum as fp_cum, round(tp_cum / rank, 6) as precision, round(tp_cum / g, 6) as recall from e cross join tot")
def _(t):
    return curve_df(t).select("model", "image_id", "pred_idx", "rank", "tp_cum", "fp_cum", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("w6_pr_envelope", VIEWS, MATCH + PR + "select model, image_id, pred_idx, rank, round(env, 6) as envelope from e")
def _(t):
    return curve_df(t).select("model", "image_id", "pred_idx", "rank", F.round("envelope", 6).alias("envelope"))


@query("a39_average_precision", VIEWS, MATCH + PR + """, s as (select model, count(*) as predictions, cast(sum(is_tp) as bigint) as tp, coalesce(sum(env) filter (where is_tp = 1), 0.0) as area from e group by model)
select model, predictions, g as gt_total, tp, round(area / g, 6) as ap, round(tp / (predictions + 1e-7), 6) as instance_precision, round(tp / (g + 1e-7), 6) as instance_recall,
  round(2 * (tp / (predictions + 1e-7)) * (tp / (g + 1e-7)) / (tp / (predictions + 1e-7) + tp / (g + 1e-7) + 1e-7), 6) as instance_f1 from s cross join tot""")
def _(t):
    return features.average_precision(matched_df(t), t.fx_gt)


@query("a39_average_precision_95", VIEWS, MATCH.replace(">= 0.5", ">= 0.95") + PR + """, s as (select model, count(*) as predictions, cast(sum(is_tp) as bigint) as tp, coalesce(sum(env) filter (where is_tp = 1), 0.0) as area from e group by model)
select model, predictions, g as gt_total, tp, round(area / g, 6) as ap from s cross join tot""")
def _(t):
    return features.average_precision(matched_df(t, 0.95), t.fx_gt).select("model", "predictions", "gt_total", "tp", "ap")


@query("w7_stable_row_id", "fx_labelled", """with i as (select image_id, cand_id, score_pct, row_number() over (order by image_id, cand_id) - 1 as verification_id from fx_labelled)
select image_id, cand_id, verification_id, row_number() over (order by score_pct desc, verification_id) as queue_pos from i""")
def _(t):
    return features.review_queue(t.fx_labelled.select("image_id", "cand_id", "score_pct"), ["image_id", "cand_id"]).drop("score_pct")


@query("w7_keep_ids", "fx_labelled", """with g as (select image_id, cand_id, score_pct, case when cand_id % 3 <> 0 then cand_id * 2 + 5 end as given from fx_labelled),
i as (select image_id, cand_id, score_pct, coalesce(given, (select max(given) from g) + row_number() over (partition by given is null order by image_id, cand_id)) as verification_id from g)
select image_id, cand_id, verification_id, row_number() over (order by score_pct desc, verification_id, image_id, cand_id) as queue_pos from i""")
def _(t):
    given = t.fx_labelled.select("image_id", "cand_id", "score_pct", F.when(F.col("cand_id") % 3 != 0, F.col("cand_id") * 2 + 5).alias("verification_id"))
    return features.review_queue(given, ["image_id", "cand_id"]).drop("score_pct")


@query("w8_review_progress", "fx_labelled", "select count(*) as total, count(*) filter (where fold <> 4) as completed, count(*) filter (where fold = 4) as remaining from fx_labelled")
def _(t):
    q = t.fx_labelled.select("image_id", "cand_id")
    given = t.fx_labelled.where("fold <> 4").select("image_id", "cand_id", F.col("label").alias("human_label"))
    return features.review_progress(q, given, ["image_id", "cand_id"])


@query("a45_best_epoch", "fx_log", "select run, epoch as best_epoch, val_loss as best_val_loss from (select *, row_number() over (partition by run order by val_loss, epoch) as rn from fx_log) q where rn = 1")
def _(t):
    return features.best_epoch(t.fx_log)


@query("a45_improvements", "fx_log", "select run, epoch, val_loss, case when b is null or val_loss < b then 1 else 0 end as improved, least(coalesce(b, val_loss), val_loss) as best_so_far from (select *, min(val_loss) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as b from fx_log) q")
def _(t):
    return features.improvements(t.fx_log)
