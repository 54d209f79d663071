"""Candidate features, review tables, rematching and label statistics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import materialise
from ..plans.ordering import from_end, running, tally
from .celltree import count_within
from .flat import outline_sizes

CROWD = 2_000


def shape_features(det: DataFrame, images: DataFrame, aspect: str = "width_height") -> DataFrame:
    """Box and mask features of each detection (x0, y0, x1, y1, area) on its image.

    `aspect` is width over height with sides of at least one pixel, or 'long_short' with a floor of 1e-6.
    """
    low = 1.0 if aspect == "width_height" else 1e-6
    w = F.greatest(F.lit(low), (F.col("x1") - F.col("x0")).cast("double"))
    h = F.greatest(F.lit(low), (F.col("y1") - F.col("y0")).cast("double"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2.0, (F.col("y0") + F.col("y1")) / 2.0
    nx, ny = cx / F.col("width"), cy / F.col("height")
    ratio = w / h if aspect == "width_height" else F.greatest(w, h) / F.least(w, h)
    return det.join(images.select("image_id", "width", "height"), "image_id").withColumns(
        {
            "bbox_width": w, "bbox_height": h, "bbox_area_px": w * h, "aspect_ratio": F.round(ratio, 6),
            "rectangularity": F.round(F.col("area") / (w * h), 6),
            "relative_mask_area": F.round(F.col("area") / (F.col("width") * F.col("height")), 14),
            "center_x_norm": F.round(nx, 9), "center_y_norm": F.round(ny, 9),
            "edge_distance_norm": F.round(F.least(nx, 1.0 - nx, ny, 1.0 - ny), 9),
        }
    ).drop("width", "height")


def outline_features(outlines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area, perimeter, hull area, compactness and solidity of a closed outline.

    `vertices` is an array of structs (x, y) of one instance's largest outline. All outlines of a batch are worked out together in
    arrays; the hull is built from the vertices in (x, y) order, lower and upper chain.
    """
    out = outlines.select(*keys, outline_sizes("vertices").alias("__s")).select(
        *keys, F.col("__s.area").alias("outline_area"), F.col("__s.perimeter").alias("perimeter"), F.col("__s.hull").alias("hull_area"))
    return out.select(
        *keys, F.round("outline_area", 6).alias("outline_area"), F.round("perimeter", 6).alias("perimeter"), F.round("hull_area", 6).alias("hull_area"),
        F.round(F.when(F.col("perimeter") > 0, 4 * F.pi() * F.col("outline_area") / (F.col("perimeter") * F.col("perimeter"))).otherwise(0.0), 6).alias("compactness"),
        F.round(F.when(F.col("hull_area") > 0, F.col("outline_area") / F.col("hull_area")).otherwise(0.0), 6).alias("solidity"),
    )


def neighbour_count(det: DataFrame, radius: int = 100, group: Sequence[str] = ("model", "image_id"), crowd: int = CROWD) -> DataFrame:
    """Other boxes of the image whose centre lies within `radius` pixels at a distance above 0.

    Centres are whole half-pixels; equal centres are folded into one row with a count, and cells of
    four radii make the range join an equi join. Images with more than `crowd` centres in a cell are counted by
    pairs of cells (`celltree`), which gives the same numbers.
    """
    group = list(group)
    size = 2 * radius
    d = det.withColumns({"c2x": F.col("x0") + F.col("x1"), "c2y": F.col("y0") + F.col("y1")})
    centres = materialise(d.groupBy(*group, "c2x", "c2y").agg(F.count("*").alias("n")), "centres")
    cell = 4 * size  # a centre reaches into few cells of four radii

    def reach(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - size) / cell), F.floor((F.col(c) + size) / cell)))

    full = centres.groupBy(*group, F.floor(F.col("c2y") / cell), F.floor(F.col("c2x") / cell)).agg(F.count("*").alias("k"))
    full = materialise(full.where(F.col("k") > crowd).select(*group).distinct(), "crowded")  # at most a row in `crowd` centres
    crowded = not full.isEmpty()
    if crowded:
        dense = centres.join(full, group, "left_semi").select(*group, F.col("c2y").alias("y"), F.col("c2x").alias("x"), F.col("n").alias("w"))
        dense = materialise(dense, "dense")

        def rim(ay: Column, ax: Column, by: Column, bx: Column, s: float) -> tuple[Column, Column]:
            least = lambda p, q: F.greatest(F.abs(p - q) - s, F.lit(0.0))
            most = lambda p, q: F.abs(p - q) + s
            return least(ay, by) * least(ay, by) + least(ax, bx) * least(ax, bx), most(ay, by) * most(ay, by) + most(ax, bx) * most(ax, bx)

        square = lambda ay, ax, by, bx: (ay - by) * (ay - by) + (ax - bx) * (ax - bx)
        near = count_within(dense, dense, group, float(size), [size * size], rim, square)
        near = near.join(dense, [*group, "y", "x"])
        # a centre meets itself and its copies at distance 0
        near = near.select(*group, F.col("x").alias("c2x"), F.col("y").alias("c2y"), (F.col("n0") - F.col("w")).alias("neighbour_count"))
        centres = centres.join(full, group, "left_anti")
    left = centres.select(*group, "c2x", "c2y", reach("c2y").alias("gy")).select("*", reach("c2x").alias("gx"))
    right = centres.select(*group, F.col("c2x").alias("ox"), F.col("c2y").alias("oy"), "n", F.floor(F.col("c2y") / cell).alias("gy"), F.floor(F.col("c2x") / cell).alias("gx"))
    dx, dy = F.col("c2x") - F.col("ox"), F.col("c2y") - F.col("oy")
    d2 = dx * dx + dy * dy
    per = left.join(right, [*group, "gy", "gx"]).where((d2 > 0) & (d2 <= size * size)).groupBy(*group, "c2x", "c2y").agg(F.sum("n").alias("neighbour_count"))
    if crowded:
        per = per.unionByName(near)
    return d.join(per, [*group, "c2x", "c2y"], "left").withColumn("neighbour_count", F.coalesce("neighbour_count", F.lit(0).cast("bigint"))).drop("c2x", "c2y")


def rematch_nearest(stored: DataFrame, current: DataFrame, cells: Sequence[int] = (64, 512)) -> DataFrame:
    """Find each stored candidate again: least mean |box difference| + 50 |score difference| in its image.

    Boxes meet in cells of their first corner. With cells of size c, anything outside the 3 x 3 neighbourhood
    is more than c / 4 away, so a best distance of at most c / 4 is final; the rest tries larger cells and at
    last the whole image. Ties go to the lowest index.
    """
    key = ["image_id", "stored_idx"]
    coords = ("x0", "y0", "x1", "y1")
    s = materialise(stored.select(*key, "score", *coords), "stored")
    c = current.select("image_id", F.col("pred_idx"), F.col("score").alias("c_score"), *[F.col(k).alias(f"c_{k}") for k in coords])
    dist = sum([F.abs(F.col(k) - F.col(f"c_{k}")) for k in coords[1:]], F.abs(F.col("x0") - F.col("c_x0"))) / 4.0 + 50.0 * F.abs(F.col("score") - F.col("c_score"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    done = []
    for size in [*cells, None]:
        if size is None:
            pairs = s.join(c, "image_id")
        else:
            left = s.withColumn("gy", F.explode(F.transform(around, lambda i: i + F.floor(F.col("y0") / size)))).withColumn(
                "gx", F.explode(F.transform(around, lambda i: i + F.floor(F.col("x0") / size))))
            right = c.withColumns({"gy": F.floor(F.col("c_y0") / size), "gx": F.floor(F.col("c_x0") / size)})
            pairs = left.join(right, ["image_id", "gy", "gx"])
        best = pairs.withColumn("distance", F.round(dist, 6)).groupBy(*key).agg(F.min(F.struct("distance", "pred_idx")).alias("b")).select(*key, "b.distance", "b.pred_idx")
        if size is None:
            done.append(best)
        else:
            found = materialise(best.where(F.col("distance") <= size / 4.0), "found")
            done.append(found)
            s = materialise(s.join(found.select(*key), key, "left_anti"), "stored")
            if not s.limit(1).count():
                break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _scores_beside(stored: DataFrame, by_score: DataFrame) -> DataFrame:
    """(image_id, stored_idx, score, c_score): the next score at or below and the next at or above each stored one.

    Both sides are put in one order, range partitioned; the next score below is a running maximum, the next above
    one in the opposite order. No stored score meets more than two others.
    """
    empty = F.lit(None).cast("double")
    rows = by_score.select("image_id", F.col("score").alias("s"), F.lit(0).alias("k"), F.col("pred_idx").alias("i"), F.col("score").alias("up"), (-F.col("score")).alias("down"))
    rows = rows.unionAll(stored.where("score is not null").select("image_id", "score", F.lit(1), "stored_idx", empty, empty))
    rows = materialise(rows, "scores")
    below = running(rows, [F.col("s"), F.col("k"), F.col("i")], by=["image_id"], pos=None, maxes={"up": "c"})
    above = running(rows, [-F.col("s"), F.col("k"), F.col("i")], by=["image_id"], pos=None, maxes={"down": "c"}).withColumn("c", -F.col("c"))
    both = below.unionByName(above).where("k = 1 and c is not null")
    return both.select("image_id", F.col("i").alias("stored_idx"), F.col("s").alias("score"), F.col("c").alias("c_score"))


def rematch_tolerance(stored: DataFrame, current: DataFrame, same: float = 0.002, close: float = 0.01, crowd: int = CROWD) -> DataFrame:
    """Same index when its score agrees within `same`, else the closest score within `close`, else unmatched.

    Equal scores of an image are folded to their lowest index first and meet in score cells of twice `close`; images with
    more than `crowd` different scores in a cell look at the next score on either side alone. Equally close scores go
    to the lowest index (gaps are compared at nine decimals; scores closer to each other than that count as ordered).
    """
    key = ["image_id", "stored_idx"]
    eps = 1e-12
    direct = stored.join(current.select("image_id", F.col("pred_idx").alias("stored_idx"), F.col("score").alias("c_score")), key)
    direct = direct.where(F.abs(F.col("c_score") - F.col("score")) <= same + eps).select(*key, F.col("stored_idx").alias("direct_idx"))
    cell = F.floor(F.col("score") / (2 * close))
    by_score = current.groupBy("image_id", "score").agg(F.min("pred_idx").alias("pred_idx"))
    right = by_score.select("image_id", F.col("score").alias("c_score"), "pred_idx", cell.alias("cell"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    full = materialise(right.groupBy("image_id", "cell").agg(F.count("*").alias("k")).where(F.col("k") > crowd).select("image_id").distinct(), "crowded")
    few = stored.join(full, "image_id", "left_anti")
    near = few.withColumn("cell", F.explode(F.transform(around, lambda i: i + cell))).join(right.join(full, "image_id", "left_anti"), ["image_id", "cell"])
    near = near.select(*key, "score", "c_score", "pred_idx")
    if not full.isEmpty():
        many = by_score.join(full, "image_id", "left_semi")
        beside = _scores_beside(stored.join(full, "image_id", "left_semi").select(*key, "score"), many)
        near = near.unionByName(beside.join(many.withColumnRenamed("score", "c_score"), ["image_id", "c_score"]).select(*key, "score", "c_score", "pred_idx"))
    gap = F.round(F.abs(F.col("c_score") - F.col("score")), 9)
    near = near.where(gap <= close).groupBy(*key).agg(F.min(F.struct(gap.alias("g"), F.col("pred_idx"))).alias("b")).select(*key, F.col("b.pred_idx").alias("near_idx"))
    out = stored.join(direct, key, "left").join(near, key, "left")
    return out.select(
        *key, F.coalesce("direct_idx", "near_idx").alias("pred_idx"),
        F.when(F.col("direct_idx").isNotNull(), "same_index").when(F.col("near_idx").isNotNull(), "closest_score").otherwise("unmatched").alias("how"),
    )


def label_distribution(df: DataFrame, col: str) -> DataFrame:
    """Count and percent per label."""
    c = df.groupBy(col).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("__t"))  # one row
    return c.join(F.broadcast(total)).select(col, "n", F.round(F.col("n") / F.col("__t") * 100.0, 2).alias("percent"))


def feature_summary(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """Mean and exact median of features per label, long form, rounded to 4 places."""
    from ..plans.ordering import exact_percentiles

    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
    long = materialise(df.select(by, F.explode(pairs).alias("s")).select(by, "s.feature", "s.v"), "features")
    keys = [by, "feature"]
    mean = long.groupBy(*keys).agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"))
    med = exact_percentiles(long, "v", {"median": 0.5}, keys).withColumn("median", F.round("median", 4))
    return mean.join(med, keys)


def score_summary(df: DataFrame, by: str, score: str = "score_pct") -> DataFrame:
    """count, min, max, mean, median and sample std of the score per label. Scores are whole percent, so the
    median's state holds at most 101 values."""
    s = F.col(score) / 100.0
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.min(s), 4).alias("min"), F.round(F.max(s), 4).alias("max"), F.round(F.avg(s), 6).alias("mean"),
        F.round(F.percentile(s, 0.5), 4).alias("median"), F.round(F.stddev_samp(s), 6).alias("std"),
    )


def feature_auc(df: DataFrame, features: Sequence[str], labels: Sequence, label: str = "label") -> DataFrame:
    """One-vs-rest ROC AUC per label and feature with mean ranks for ties; separability = max(auc, 1 - auc).

    Equal feature values are counted first; ranks come from the running count over distinct values.
    Labels without both classes are left out.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).try_cast("double").alias("v")) for c in features])
    long = df.select(label, F.explode(pairs).alias("s")).select(label, "s.feature", "s.v").where("v is not null")
    counts = long.groupBy("feature", "v").agg(
        F.count("*").alias("c"), *[F.count_if(F.col(label) == x).alias(f"c{i}") for i, x in enumerate(labels)]
    )
    cum = running(counts, [F.col("v")], ["feature"], pos=None, sums={"c": "cum"})
    rank = (F.col("cum") - F.col("c")) + (F.col("c") + 1) / 2.0
    agg = cum.groupBy("feature").agg(
        F.sum("c").alias("n"), *[F.sum(f"c{i}").alias(f"n{i}") for i in range(len(labels))], *[F.sum(F.col(f"c{i}") * rank).alias(f"r{i}") for i in range(len(labels))]
    )
    rows = F.array(*[F.struct(F.lit(x).alias("target_label"), F.col(f"n{i}").alias("n1"), F.col(f"r{i}").alias("r1")) for i, x in enumerate(labels)])
    long = agg.select("feature", "n", F.explode(rows).alias("s")).select("feature", "n", "s.*").where("n1 > 0 and n1 < n")
    auc = (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0) / (F.col("n1") * (F.col("n") - F.col("n1")))
    return long.select("target_label", "feature", F.round(auc, 4).alias("auc"), F.round(F.greatest(auc, 1.0 - auc), 4).alias("separability"))


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First `k` rows of each group. The engine keeps only `k` rows per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_models(scores: DataFrame, metric: str, name: str = "model") -> DataFrame:
    """Compared models by metric, best first; one row per model, so the ranking window is tiny."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(metric).desc(), F.col(name))))


def confusion_matrix(df: DataFrame, labels: Sequence, true: str = "label", pred: str = "predicted") -> DataFrame:
    """True x predicted counts over the given labels, zeros kept."""
    counts = df.groupBy(true).agg(*[F.count_if(F.col(pred) == x).alias(f"pred_{x}") for x in labels])
    rows = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias(true))
    out = rows.join(counts, true, "left")
    return out.select(true, *[F.coalesce(f"pred_{x}", F.lit(0).cast("bigint")).alias(f"pred_{x}") for x in labels])


def class_report(df: DataFrame, labels: Sequence, by: Sequence[str] = (), true: str = "label", pred: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, 0/0 -> 0."""
    cells = df.groupBy(*by, true, pred).agg(F.count("*").alias("n"))
    long = cells.select(*by, true, pred, "n", F.explode(F.array(*[F.lit(x) for x in labels])).alias("cls"))
    t, p = F.col(true) == F.col("cls"), F.col(pred) == F.col("cls")
    agg = long.groupBy(*by, "cls").agg(
        F.sum(F.when(t & p, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(p, F.col("n")).otherwise(0)).alias("np"), F.sum(F.when(t, F.col("n")).otherwise(0)).alias("support")
    )
    pr = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0)
    re = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return agg.select(*by, "cls", "support", "tp", "np", pr.alias("precision"), re.alias("recall"), F.when(pr + re > 0, 2 * pr * re / (pr + re)).otherwise(0.0).alias("f1"))


def classification_report(df: DataFrame, labels: Sequence, by: Sequence[str] = (), true: str = "label", pred: str = "predicted") -> DataFrame:
    """Accuracy, balanced accuracy and macro precision, recall and F1.

    Macro values average over labels seen as truth or prediction, balanced accuracy over labels seen as truth.
    """
    r = class_report(df, labels, by, true, pred)
    seen = (F.col("support") > 0) | (F.col("np") > 0)
    return r.groupBy(*by).agg(
        F.sum("support").alias("n"), F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"),
        F.round(F.avg(F.when(F.col("support") > 0, F.col("recall"))), 6).alias("balanced_accuracy"),
        *[F.round(F.avg(F.when(seen, F.col(c))), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
    )


def hard_negatives(det: DataFrame, negatives: DataFrame, threshold: int = 75) -> DataFrame:
    """Per negative image: counts, max and mean scores, priority = high count x mean high score, and the flag."""
    high = F.col("score_pct") >= threshold
    per = det.groupBy("image_id").agg(
        F.count("*").alias("raw"), F.count_if(high).alias("high"), F.max("score_pct").alias("mx"), F.sum("score_pct").alias("s"), F.sum(F.when(high, F.col("score_pct"))).alias("sh")
    )
    j = negatives.join(per, "image_id", "left")
    zero = F.lit(0).cast("bigint")
    raw, n_high = F.coalesce("raw", zero), F.coalesce("high", zero)
    return j.select(
        "image_id", "filename", raw.alias("raw_prediction_count"), n_high.alias("high_confidence_prediction_count"),
        F.coalesce(F.col("mx") / 100.0, F.lit(0.0)).alias("max_confidence"),
        F.round(F.coalesce(F.col("s") / F.col("raw") / 100.0, F.lit(0.0)), 6).alias("mean_confidence_all"),
        F.round(F.when(n_high > 0, F.col("sh") / n_high / 100.0).otherwise(0.0), 6).alias("mean_confidence_high"),
        F.round(F.coalesce(F.col("sh") / 100.0, F.lit(0.0)), 6).alias("priority_score"),
        (n_high > 0).cast("int").alias("is_hard_negative"),
    )


def mining_summary(hn: DataFrame) -> DataFrame:
    """Hard images, their rate, and total and mean high-score predictions."""
    return hn.agg(
        F.count("*").alias("images"), F.sum("is_hard_negative").alias("hard_images"), F.round(F.avg("is_hard_negative") * 100.0, 6).alias("hard_rate_percent"),
        F.sum("high_confidence_prediction_count").alias("high_predictions"), F.round(F.avg("high_confidence_prediction_count"), 6).alias("mean_high_per_image"),
    )


def best_epoch(log: DataFrame) -> DataFrame:
    """Epoch of least validation loss per run (the first one on ties)."""
    return log.groupBy("run").agg(F.min(F.struct("val_loss", "epoch")).alias("b")).select("run", F.col("b.epoch").alias("best_epoch"), F.col("b.val_loss").alias("best_val_loss"))


def improvements(log: DataFrame) -> DataFrame:
    """Each epoch with the best loss so far and whether it improved on it (one row per run and epoch)."""
    w = Window.partitionBy("run").orderBy("epoch")
    before = F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("improved", (before.isNull() | (F.col("val_loss") < before)).cast("int")).withColumn(
        "best_so_far", F.least(F.coalesce(before, F.col("val_loss")), F.col("val_loss"))
    )


def review_queue(df: DataFrame, keys: Sequence[str], score: str = "score_pct") -> DataFrame:
    """Stable ids from a declared row key, then ordered by score: adds `verification_id` and `queue_pos`.

    Ids that are there stay; rows without one are numbered on from the highest, or from 0 if there is none.
    """
    name = "verification_id"
    old = df if name in df.columns else df.withColumn(name, F.lit(None).cast("bigint"))
    old = materialise(old, "reviews")
    top = old.agg(F.max(name)).first()[0]
    new = running(old.where(F.col(name).isNull()), [F.col(k) for k in keys], pos="__id")
    new = new.withColumn(name, F.col("__id") + (-1 if top is None else top)).drop("__id")
    ids = old.where(F.col(name).isNotNull()).unionByName(new)
    return running(ids, [-F.col(score), F.col(name), *[F.col(k) for k in keys]], pos="queue_pos")


def review_progress(queue: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finished and remaining reviews after joining the labels given so far."""
    j = queue.join(labels.select(*keys, F.col("human_label")), list(keys), "left")
    return j.agg(F.count("*").alias("total"), F.count("human_label").alias("completed"), F.count_if(F.col("human_label").isNull()).alias("remaining"))


def average_precision(matched: DataFrame, gts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Average precision over the global score order with the monotone precision envelope.

    `matched` holds one row per prediction with `is_tp`. Recall moves only at hits, so the area is the sum
    over hits of envelope / ground truths. Running counts and the running maximum from the end use range
    partitions, not one sorted task.
    """
    by = list(by)
    total = gts.agg(F.count("*").alias("gt_total"))  # one row
    n = matched.select(*by, "image_id", "pred_idx", "score_pct", F.col("is_tp").cast("bigint").alias("is_tp"))
    order = [-F.col("score_pct"), F.col("image_id"), F.col("pred_idx")]
    cum = tally(n, order, "is_tp", by).withColumn("precision", F.col("tp_cum") / F.col("rank"))
    # between two hits precision falls, so the envelope at a hit is the highest precision of the hits from it on
    area = from_end(cum.where("is_tp = 1").select(*by, "__pid", "rank", "precision"), "precision", "envelope", by)
    area = area.groupBy(*by).agg(F.sum("envelope").alias("area"))
    agg = cum.groupBy(*by).agg(F.max("tp_cum").alias("tp"), F.max("rank").alias("predictions"))
    out = (agg.join(area, by, "left") if by else agg.crossJoin(area)).join(F.broadcast(total))
    p = F.col("tp") / (F.col("predictions") + 1e-7)
    r = F.col("tp") / (F.col("gt_total") + 1e-7)
    return out.select(
        *by, "predictions", F.col("gt_total"), "tp", F.round(F.coalesce("area", F.lit(0.0)) / F.greatest(F.col("gt_total"), F.lit(1)), 6).alias("ap"),
        F.round(p, 6).alias("instance_precision"), F.round(r, 6).alias("instance_recall"), F.round(2 * p * r / (p + r + 1e-7), 6).alias("instance_f1"),
    )


def pr_curve(matched: DataFrame, gt_total: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Running precision and recall in global score order, with the precision envelope from the end."""
    by = list(by)
    n = matched.select(*by, "image_id", "pred_idx", "score_pct", F.col("is_tp").cast("bigint").alias("is_tp"))
    cum = tally(n, [-F.col("score_pct"), F.col("image_id"), F.col("pred_idx")], "is_tp", by)
    cum = cum.join(F.broadcast(gt_total)).withColumns({
        "fp_cum": F.col("rank") - F.col("tp_cum"), "precision": F.col("tp_cum") / F.col("rank"), "recall": F.col("tp_cum") / F.greatest(F.col("gt_total"), F.lit(1))})
    return from_end(cum, "precision", "envelope", by)
