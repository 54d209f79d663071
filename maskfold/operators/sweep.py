"""Score-threshold sweeps over detections that were matched once, and over pixels bucketed once."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import materialise
from ..plans.ordering import exact_percentiles

EPS = 1e-7


def ratio(num: Column, den: Column) -> Column:
    """num / den with 0/0 -> 0."""
    return F.when(den != 0, num / den).otherwise(0.0)


def _level(value: Column, levels: list) -> Column:
    """The highest of the ascending `levels` that `value` reaches, null below all: a binary choice, compiled as plain code."""
    if not levels:
        return F.lit(None)
    if len(levels) == 1:
        return F.when(value >= levels[0], F.lit(levels[0]))
    mid = len(levels) // 2
    return F.when(value >= levels[mid], F.lit(levels[mid]) if mid == len(levels) - 1 else _level(value, levels[mid:])).otherwise(_level(value, levels[:mid]))


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of counts, 0/0 -> 0."""
    p = ratio(F.col(tp), F.col(tp) + F.col(fp))
    r = ratio(F.col(tp), F.col(tp) + F.col(fn))
    return p, r, ratio(2 * p * r, p + r)


def sweep_detections(
    matched: DataFrame, gts: DataFrame, images: DataFrame, thresholds: Sequence[float], models: Sequence[str], by: Sequence[str] = (),
    score: str = "score_pct", scale: float = 100.0,
) -> DataFrame:
    """Detection and negative-image metrics per model and score threshold.

    `thresholds` are in the unit of the column `score`, `scale` is the score that stands for 1: whole percent by
    default, or any real scores with scale 1. A score counts for the highest threshold it reaches, so per image
    only thresholds at which something happens are kept. At each of them the image's contribution changes
    by a delta (|count error|, |area error|, hits, ...); deltas are summed per (model, threshold) and run down the
    thresholds. Nothing is multiplied by the number of thresholds before that last, tiny step.
    """
    by = list(by)
    gt_img = gts.groupBy("image_id").agg(F.count("*").alias("g_n"), F.sum("area").alias("g_area"))
    imgs = images.select("image_id", "has_solar", *by).join(gt_img, "image_id", "left").withColumns(
        {"g_n": F.coalesce("g_n", F.lit(0).cast("bigint")), "g_area": F.coalesce("g_area", F.lit(0).cast("bigint"))}
    )
    pos = F.col("has_solar") == 1
    totals = imgs.groupBy(*by).agg(
        F.count_if(pos).alias("positive_images"),
        F.count_if(~pos).alias("negative_images"),
        F.sum(F.when(pos, F.col("g_n"))).alias("gt_n"),
        F.sum(F.when(pos, F.col("g_n") * F.col("g_n"))).alias("gt_sq"),
        F.count_if(pos & (F.col("g_area") > 0)).alias("area_images"),
    )
    levels = [int(t) for t in thresholds] if all(float(t).is_integer() for t in thresholds) else [float(t) for t in thresholds]
    steps = matched.withColumn("__s", _level(F.col(score), sorted(set(levels)))).where("__s is not null")
    # the id comes first: rows are sorted by their first key
    steps = steps.groupBy("image_id", "model", "__s").agg(
        F.count("*").alias("n"), F.sum("is_tp").alias("tp"), F.sum("area").alias("a"), F.sum("iou").alias("iou_sum"),
        F.sum(score).alias("s_sum"), F.max(score).alias("s_max"),
    )
    w = Window.partitionBy("image_id", "model").orderBy(F.col("__s").desc())
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = steps.join(imgs, "image_id").select(
        *by, "model", "__s", "n", "tp", "iou_sum", "s_sum", "s_max", "g_n", "g_area", pos.alias("pos"),
        F.sum("n").over(run).alias("cn"), F.sum("a").over(run).alias("ca"), "a",
    )
    err1, err0 = F.col("cn") - F.col("g_n"), F.col("cn") - F.col("n") - F.col("g_n")
    a1 = F.abs(F.col("ca") - F.col("g_area")) / F.col("g_area")
    a0 = F.abs(F.col("ca") - F.col("a") - F.col("g_area")) / F.col("g_area")
    on_pos, on_neg = F.col("pos"), ~F.col("pos")
    delta = s.groupBy(*by, "model", "__s").agg(
        F.sum(F.when(on_pos, F.col("tp")).otherwise(0)).alias("d_tp"),
        F.sum(F.when(on_pos, F.col("n")).otherwise(0)).alias("d_n"),
        F.sum(F.when(on_pos, F.col("iou_sum")).otherwise(0.0)).alias("d_iou"),
        F.sum(F.when(on_pos, F.abs(err1) - F.abs(err0)).otherwise(0)).alias("d_abs"),
        F.sum(F.when(on_pos, err1 * err1 - err0 * err0).otherwise(0)).alias("d_sq"),
        F.sum(F.when(on_pos & (F.col("g_area") > 0), a1 - a0).otherwise(0.0)).alias("d_area"),
        F.sum(F.when(on_neg & (F.col("cn") == F.col("n")), 1).otherwise(0)).alias("d_negimg"),
        F.sum(F.when(on_neg, F.col("n")).otherwise(0)).alias("d_negn"),
        F.sum(F.when(on_neg, F.col("s_sum")).otherwise(0)).alias("d_negscore"),
        F.max(F.when(on_neg, F.col("s_max"))).alias("d_negmax"),
    )
    # from here on: (by x models x thresholds) rows
    names = [c for c in delta.columns if c.startswith("d_")]
    grid = totals.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).withColumn(
        "threshold_pct", F.explode(F.array(*[F.lit(t) for t in levels]))
    )
    cond = [F.col(f"g.{b}") == F.col(f"d.{b}") for b in [*by, "model"]] + [F.col("d.__s") >= F.col("g.threshold_pct")]
    keys = [F.col(f"g.{c}") for c in [*by, "model", "threshold_pct", *[c for c in totals.columns if c not in by]]]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    agg = grid.alias("g").join(delta.alias("d"), on, "left").groupBy(*keys).agg(
        *[(F.max if c == "d_negmax" else F.sum)(F.col(f"d.{c}")).alias(c) for c in names]
    )
    agg = agg.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names})
    agg = agg.withColumns({"tp": F.col("d_tp"), "fp": F.col("d_n") - F.col("d_tp"), "fn": F.col("gt_n") - F.col("d_tp")})
    p, r, f1 = prf()
    n_pos, n_neg = F.col("positive_images"), F.col("negative_images")
    return agg.select(
        *by, "model", F.col("threshold_pct").alias("threshold_pct" if scale == 100.0 else "threshold"), "tp", "fp", "fn",
        F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"),
        F.round(ratio(F.col("gt_n") + F.col("d_abs"), n_pos), 6).alias("count_mae"),
        F.round(F.sqrt(ratio(F.col("gt_sq") + F.col("d_sq"), n_pos)), 6).alias("count_rmse"),
        F.round(ratio(F.col("area_images") + F.col("d_area"), F.col("area_images")) * 100.0, 4).alias("area_mape"),
        F.round(ratio(F.col("d_iou"), F.col("d_tp")), 6).alias("mean_matched_iou"),
        F.col("d_negimg").cast("bigint").alias("negative_fp_images"),
        F.col("negative_images").alias("negative_total_images"),
        F.round(ratio(F.col("d_negimg"), n_neg) * 100.0, 6).alias("negative_fp_rate_percent"),
        F.col("d_negn").alias("negative_total_predictions"),
        F.round(ratio(F.col("d_negn"), n_neg), 6).alias("negative_avg_predictions"),
        F.round(ratio(F.col("d_negscore"), F.col("d_negn")) / F.lit(scale), 6).alias("negative_mean_score"),
        F.round(F.col("d_negmax") / F.lit(scale), 6).alias("negative_max_score"),
    )


def pick_threshold(sweep: DataFrame, by: Sequence[str] = ("model",), threshold: str = "threshold_pct") -> DataFrame:
    """Best threshold per model: F1, then fewer negative hits, then recall, then the lower threshold."""
    w = Window.partitionBy(*by).orderBy(
        F.col("f1").desc(), F.col("negative_fp_rate_percent"), F.col("recall").desc(), F.col(threshold)
    )
    return sweep.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def per_image_detection(
    matched: DataFrame, gts: DataFrame, images: DataFrame, thresholds: Sequence[int], models: Sequence[str]
) -> DataFrame:
    """One row per model, image and threshold: counts, areas, errors and verdicts."""
    ts = F.array(*[F.lit(int(t)) for t in thresholds])
    got = (
        matched.withColumn("threshold_pct", F.explode(F.filter(ts, lambda t: t <= F.col("score_pct"))))
        .groupBy("model", "image_id", "threshold_pct")
        .agg(F.count("*").alias("n"), F.sum("is_tp").alias("t"), F.sum("area").alias("a"), F.avg("iou").alias("miou"))
    )
    # one row per image: at most models x thresholds entries, so image and counts meet by image alone
    entry = F.struct(F.struct("model", "threshold_pct").alias("k"), F.struct("n", "t", "a", "miou").alias("v"))
    got = got.groupBy("image_id").agg(F.map_from_entries(F.collect_list(entry)).alias("got"))
    gt_img = gts.groupBy("image_id").agg(F.count("*").alias("g_n"), F.sum("area").alias("g_area"))
    base = images.select("image_id").join(gt_img, "image_id", "left").join(got, "image_id", "left").withColumn(
        "model", F.explode(F.array(*[F.lit(m) for m in models]))
    ).withColumn("threshold_pct", F.explode(ts))
    base = base.withColumn("at", F.try_element_at("got", F.struct("model", "threshold_pct")))
    zero = F.lit(0).cast("bigint")
    out = base.select("model", "image_id", "threshold_pct", "g_n", "g_area", "at.*").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("n", "t", "a", "g_n", "g_area")}
    )
    err = F.col("a") - F.col("g_area")
    return out.select(
        "model", "image_id", "threshold_pct",
        F.col("g_n").alias("gt_count"), F.col("n").alias("pred_count"), (F.col("n") - F.col("g_n")).alias("count_error"),
        F.col("g_area").alias("gt_area"), F.col("a").alias("pred_area"), err.alias("area_error"),
        F.abs(err).alias("area_abs_error"),
        F.when(F.col("g_area") > 0, F.round(F.abs(err) / F.col("g_area") * 100.0, 6)).alias("area_percent_error"),
        F.col("t").alias("tp"), (F.col("n") - F.col("t")).alias("fp"), (F.col("g_n") - F.col("t")).alias("fn"),
        F.round(F.coalesce("miou", F.lit(0.0)), 6).alias("mean_matched_iou"),
    )


def sweep_wide(per_image: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """One row per model and image with thr_<t>_<metric> columns."""
    cols = {"tp": "TP", "fp": "FP", "fn": "FN", "pred_count": "predicted_count", "count_error": "count_error"}
    return per_image.groupBy("model", "image_id").agg(
        F.max("gt_count").alias("gt_count"),
        *[
            F.max(F.when(F.col("threshold_pct") == int(t), F.col(c))).alias(f"thr_{t / 100:.2f}_{name}".replace(".", "_"))
            for t in thresholds
            for c, name in cols.items()
        ],
    )


def method_comparison(per_image: DataFrame, baseline: str) -> DataFrame:
    """Pooled counts per method and threshold with the F1 change against `baseline`."""
    pooled = per_image.groupBy("model", "threshold_pct").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg(F.abs("count_error")).alias("mae"), F.avg(F.col("count_error") * F.col("count_error")).alias("mse"),
    )
    p = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    f1 = 2 * p * r / F.greatest(F.lit(1e-12), p + r)
    m = pooled.select(
        "model", "threshold_pct", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        f1.alias("f1"), F.round("mae", 6).alias("count_mae"), F.round(F.sqrt("mse"), 6).alias("count_rmse"),
    )
    base = m.where(F.col("model") == baseline).select("threshold_pct", F.col("f1").alias("base_f1"))
    return m.join(base, "threshold_pct").select(
        *[c for c in m.columns if c != "f1"], F.round("f1", 6).alias("f1"), F.round(F.col("f1") - F.col("base_f1"), 6).alias("f1_change")
    )


def sweep_pixels(pixels: DataFrame, thresholds: Sequence[float], prob: str = "p", truth: str = "gt") -> DataFrame:
    """Micro and positive-image pixel metrics (means, exact medians of Dice and IoU) at several probability thresholds in one pass.

    Each pixel is counted once, under the number of thresholds it passes; counts at a threshold are
    sums over the higher buckets. After the per-image aggregation there are at most
    len(thresholds) + 1 rows per image.
    """
    ts = sorted(thresholds)
    passed = sum([(F.col(prob) >= F.lit(t)).cast("int") for t in ts], F.lit(0))
    per = pixels.groupBy("image_id", passed.alias("bucket")).agg(
        F.sum(F.col(truth).cast("bigint")).alias("t"), F.count("*").alias("n")
    )
    # one row per image with the bucket counts side by side
    sums = []
    for i in range(len(ts)):
        hit = F.col("bucket") > i
        sums += [F.sum(F.when(hit, F.col("t")).otherwise(0)).alias(f"tp{i}"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(f"n{i}")]
    img = per.groupBy("image_id").agg(F.sum("t").alias("gt"), F.sum("n").alias("total"), *sums)
    long = img.select(
        "image_id", "gt", "total",
        F.explode(F.array(*[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"n{i}").alias("np")) for i, t in enumerate(ts)
        ])).alias("s"),
    ).select("image_id", "gt", "total", "s.*")
    tp, fp, fn = F.col("tp"), F.col("np") - F.col("tp"), F.col("gt") - F.col("tp")
    none = F.col("np") == 0
    dice = F.when(none, 0.0).otherwise(2.0 * tp / (2.0 * tp + fp + fn + EPS))
    iou = F.when(none, 0.0).otherwise(tp / (tp + fp + fn + EPS))
    prec = F.when(none, 0.0).otherwise(tp / (tp + fp + EPS))
    rec = F.when(none, 0.0).otherwise(tp / (tp + fn + EPS))
    has = F.col("gt") > 0
    long = materialise(long.select("threshold", "gt", "total", "np", "tp", dice.alias("dice"), iou.alias("iou")), "sweep")
    dice, iou = F.col("dice"), F.col("iou")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("dice", "iou")])
    values = long.where(has).select("threshold", F.inline(each))
    median = exact_percentiles(values, "v", {"median": 0.5}, ["threshold", "metric"])
    median = median.groupBy("threshold").agg(*[F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"median_{m}") for m in ("dice", "iou")])
    agg = long.groupBy("threshold").agg(
        F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"), F.sum(F.col("total") - F.col("np") - F.col("gt") + tp).alias("tn"),
        F.avg(F.when(has, dice)).alias("mean_dice"), F.avg(F.when(has, iou)).alias("mean_iou"),
        F.avg(F.when(has, prec)).alias("mean_precision"), F.avg(F.when(has, rec)).alias("mean_recall"),
    ).join(median, "threshold", "left")
    t, f, n = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select(
        "threshold", "tp", "fp", "fn", "tn",
        F.round(2.0 * t / (2.0 * t + f + n + EPS), 4).alias("micro_dice"),
        F.round(t / (t + f + n + EPS), 4).alias("micro_iou"),
        F.round(t / (t + f + EPS), 4).alias("micro_precision"),
        F.round(t / (t + n + EPS), 4).alias("micro_recall"),
        F.round((t + F.col("tn")) / (t + F.col("tn") + f + n), 4).alias("micro_accuracy"),
        *[F.round(c, 4).alias(c) for c in ("mean_dice", "median_dice", "mean_iou", "median_iou", "mean_precision", "mean_recall")],
    )
