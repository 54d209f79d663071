"""Instance overlap, one-to-one matching and mask suppression."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import materialise
from .masks import CELL, to_cells

FOLD_LIMIT = 1024


def iou_pairs(
    left: DataFrame,
    right: DataFrame,
    left_id: str = "pred_idx",
    right_id: str = "gt_idx",
    on: Sequence[str] = ("image_id",),
    extra: Sequence[str] = ("model", "score_pct"),
    min_iou: float | None = None,
    cell: int = CELL,
    ordered: bool = False,
) -> DataFrame:
    """IoU of all overlapping mask pairs.

    Both sides are disjoint blocks per instance with the instance's pixel count in `area`. The join key
    is (image, cell), so only masks that share a cell meet; overlaps of the cut pieces add up exactly.
    `ordered` keeps one direction of a self join (left before right by id).
    """
    on, extra = list(on), list(extra)
    a = to_cells(left.select(*extra, *on, left_id, "area", "y0", "y1", "x0", "x1"), cell, cell)
    b = to_cells(right.select(*[c for c in on], right_id, F.col("area").alias("b_area"), *[F.col(c).alias(f"b_{c}") for c in ("y0", "y1", "x0", "x1")],
                              F.col("y0").alias("y0"), F.col("y1").alias("y1"), F.col("x0").alias("x0"), F.col("x1").alias("x1")), cell, cell)
    b = b.select(*on, right_id, "b_area", "cy", "cx", *[F.col(c).alias(f"r_{c}") for c in ("y0", "y1", "x0", "x1")])
    meet = (F.col("y0") < F.col("r_y1")) & (F.col("r_y0") < F.col("y1")) & (F.col("x0") < F.col("r_x1")) & (F.col("r_x0") < F.col("x1"))
    joined = a.join(b, [*on, "cy", "cx"]).where(meet)
    if ordered:
        joined = joined.where(F.col(left_id) < F.col(right_id))
    overlap = (F.least("y1", "r_y1") - F.greatest("y0", "r_y0")).cast("bigint") * (F.least("x1", "r_x1") - F.greatest("x0", "r_x0"))
    # the pixel counts ride along as grouping columns: they are fixed by the ids and save two joins
    pairs = joined.groupBy(*extra, *on, left_id, right_id, "area", "b_area").agg(F.sum(overlap).alias("inter"))
    out = pairs.select(
        *extra, *on, left_id, right_id, "inter", (F.col("area") + F.col("b_area") - F.col("inter")).alias("union_px"),
    ).withColumn("iou", F.col("inter") / F.col("union_px"))
    if min_iou is not None:
        out = out.where(F.col("iou") >= min_iou)
    return out


def keep_score(dets: DataFrame, least: float, score: str = "score_pct") -> DataFrame:
    """Detections whose score reaches `least`; null scores do not."""
    return dets.where(F.col(score) >= least)


def _hot_groups(pairs: DataFrame, group: list[str], limit: int) -> DataFrame:
    return pairs.groupBy(*group).agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select(*group)


def pick_one_to_one(
    pairs: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = ("model", "image_id"),
    left: str = "pred_idx",
    right: str = "gt_idx",
    keep: Sequence[str] = ("iou",),
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Greedy one-to-one choice: walk the pairs in `order`, take a pair when both ends are still free.

    Groups up to `fold_limit` pairs are walked by one native fold. Larger ones (a mosaic, a third of
    the data in one image) are solved in rounds over the whole cluster: a pair that comes first both at
    its left and at its right end is what the walk would take, so all such pairs are taken at once and
    their neighbours dropped. Groups that shrink below the limit finish in the fold. Same result either way.
    Gives the chosen pairs with the columns in `keep`.
    """
    group = list(group)
    o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(left), F.col(right), *[F.col(k) for k in keep])
    work = materialise(pairs.select(*group, left, right, o.alias("o")), "pairs")
    hot = materialise(_hot_groups(work, group, fold_limit), "hot")
    if not hot.limit(1).count():
        return _pick_by_fold(work, group, left, right, keep)
    # the list of hot groups is bounded by pairs / fold_limit
    chosen = [_pick_by_fold(work.join(hot, group, "left_anti"), group, left, right, keep)]
    rest = materialise(work.join(hot, group, "left_semi"), "rest")
    while True:
        first_l = rest.groupBy(*group, left).agg(F.min("o").alias("ol"))
        first_r = rest.groupBy(*group, right).agg(F.min("o").alias("orr"))
        won = rest.join(first_l, [*group, left]).join(first_r, [*group, right])
        won = materialise(won.where((F.col("o") == F.col("ol")) & (F.col("o") == F.col("orr"))).select(*group, left, right, *[F.col(f"o.{k}").alias(k) for k in keep]), "won")
        chosen.append(won)
        rest = materialise(
            rest.join(won.select(*group, left), [*group, left], "left_anti").join(won.select(*group, right), [*group, right], "left_anti"),
            "rest",
        )
        hot = materialise(_hot_groups(rest, group, fold_limit), "hot")
        if not hot.limit(1).count():
            chosen.append(_pick_by_fold(rest, group, left, right, keep))
            break
        chosen.append(_pick_by_fold(rest.join(hot, group, "left_anti"), group, left, right, keep))
        rest = rest.join(hot, group, "left_semi")
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out


def _pick_by_fold(work: DataFrame, group: list[str], left: str, right: str, keep: Sequence[str]) -> DataFrame:
    types = dict(work.dtypes)
    zero = F.struct(
        F.array().cast(f"array<{types[left]}>").alias("ls"), F.array().cast(f"array<{types[right]}>").alias("rs"),
        F.array().cast(f"array<{types['o']}>").alias("won"),
    )

    def step(acc: Column, x: Column) -> Column:
        taken = F.array_contains(acc["ls"], x[left]) | F.array_contains(acc["rs"], x[right])
        return F.when(taken, acc).otherwise(
            F.struct(
                F.concat(acc["ls"], F.array(x[left])).alias("ls"), F.concat(acc["rs"], F.array(x[right])).alias("rs"),
                F.concat(acc["won"], F.array(x)).alias("won"),
            )
        )

    return (
        work.groupBy(*group).agg(F.array_sort(F.collect_list("o")).alias("a"))
        .select(*group, F.explode(F.aggregate("a", zero, step, lambda acc: acc["won"])).alias("z"))
        .select(*group, *[F.col(f"z.{c}").alias(c) for c in (left, right, *keep)])
    )


def match_greedy(
    pairs: DataFrame, preds: DataFrame, iou: float = 0.5, score: str = "score_pct", fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """Predictions in score order take the best unused ground truth; a hit needs IoU >= `iou`.

    Only pairs at or above the IoU bound can end in a hit, and a miss leaves its ground truth free, so
    the walk over predictions equals a greedy walk over those pairs by (score desc, prediction, IoU desc,
    ground truth). A verdict never depends on lower-scored predictions: one matching serves every score
    threshold. Gives each prediction with `gt_idx`, `iou` (null for a miss) and `is_tp`.
    """
    strong = pairs.where(F.col("iou") >= iou)
    hit = pick_one_to_one(
        strong, [-F.col(score), F.col("pred_idx"), -F.col("iou"), F.col("gt_idx")], fold_limit=fold_limit
    )
    return preds.join(hit, ["model", "image_id", "pred_idx"], "left").withColumn(
        "is_tp", F.col("gt_idx").isNotNull().cast("int")
    )


def match_iou_first(pairs: DataFrame, iou: float = 0.5, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """One-to-one matching that takes the highest IoU first, then keeps IoU >= `iou`.

    This is not the optimal-assignment solver: the optimum may give up one valid match for two weak
    ones that are filtered away afterwards; taking the highest IoU first never does.
    """
    strong = pairs.where(F.col("iou") >= iou)
    return pick_one_to_one(strong, [-F.col("iou"), F.col("pred_idx"), F.col("gt_idx")], fold_limit=fold_limit)


def match_details(matched: DataFrame, pairs: DataFrame, score: str = "score_pct") -> DataFrame:
    """Per prediction: the best ground truth still free at its turn, IoU, verdict, area and box.

    For a miss the candidates are the overlapping ground truths that no earlier prediction had taken;
    a prediction that overlaps none keeps a null ground truth and IoU 0.
    """
    key = ["model", "image_id", "pred_idx"]
    turn = F.struct((-F.col(score)).alias("s"), F.col("pred_idx").alias("p"))
    taken = matched.where("is_tp = 1").select("model", "image_id", "gt_idx", turn.alias("taken"))
    miss = matched.where("is_tp = 0").select(*key, turn.alias("turn"))
    free = (
        miss.join(pairs.select(*key, "gt_idx", "iou"), key)
        .join(taken, ["model", "image_id", "gt_idx"], "left")
        .where(F.col("taken").isNull() | (F.col("taken") > F.col("turn")))
        .groupBy(*key)
        .agg(F.min(F.struct((-F.col("iou")).alias("i"), F.col("gt_idx").alias("g"))).alias("b"))
        .select(*key, F.col("b.g").alias("free_gt"), (-F.col("b.i")).alias("free_iou"))
    )
    return matched.join(free, key, "left").select(
        *key,
        score,
        F.coalesce("gt_idx", "free_gt").alias("best_gt_idx"),
        F.round(F.coalesce("iou", "free_iou", F.lit(0.0)), 6).alias("mask_iou"),
        F.when(F.col("is_tp") == 1, "TP").otherwise("FP").alias("classification"),
        "area", "x0", "y0", "x1", "y1",
    )


def max_iou_any(misses: DataFrame, pairs: DataFrame, self_pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """For each unmatched prediction: highest IoU with any ground truth and with any matched prediction.

    `self_pairs` holds both directions as (pred_idx, other_idx).
    """
    key = ["model", "image_id", "pred_idx"]
    with_gt = pairs.groupBy(*key).agg(F.max("iou").alias("max_gt_iou"))
    with_hit = (
        self_pairs.join(hits.select("model", "image_id", F.col("pred_idx").alias("other_idx")), ["model", "image_id", "other_idx"], "left_semi")
        .groupBy(*key).agg(F.max("iou").alias("max_matched_iou"))
    )
    out = misses.join(with_gt, key, "left").join(with_hit, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("max_gt_iou", "max_matched_iou")})


def fp_category(duplicate_iou: float = 0.30, background_iou: float = 0.10) -> Column:
    """Diagnosis of a false positive from its two highest IoUs."""
    return (
        F.when(F.col("max_matched_iou") >= duplicate_iou, "DUPLICATE_LIKE")
        .when(F.col("max_gt_iou") < background_iou, "BACKGROUND_LIKE")
        .otherwise("AMBIGUOUS")
    )


def both_ways(self_pairs: DataFrame) -> DataFrame:
    """Ordered self pairs (pred_idx < other_idx) to both directions."""
    own, other = F.col("pred_idx"), F.col("other_idx")
    # from one pass: the pairs below may be an expensive join
    turned = F.array(F.struct(own.alias("pred_idx"), other.alias("other_idx")), F.struct(other.alias("pred_idx"), own.alias("other_idx")))
    return self_pairs.select("model", "image_id", F.explode(turned).alias("d"), "iou").select("model", "image_id", "d.pred_idx", "d.other_idx", "iou")


def mask_nms(
    dets: DataFrame, self_pairs: DataFrame, iou: float = 0.5, score: str = "score_pct", fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """Drop a mask that overlaps a kept, higher-scored one at IoU >= `iou`; gives the kept detections.

    Edges run from the higher- to the lower-scored mask. Small images fold their edges in order of the
    lower mask; large ones go in rounds: a mask without an undecided higher neighbour is kept, what it
    overlaps is dropped.
    """
    key = ["model", "image_id", "pred_idx"]
    group = ["model", "image_id"]
    rank = dets.select(*key, F.struct((-F.col(score)).alias("s"), F.col("pred_idx").alias("p")).alias("o"))
    strong = self_pairs.where(F.col("iou") >= iou).select("model", "image_id", "pred_idx", "other_idx")
    edges = (
        strong.join(rank, key)
        .join(rank.select("model", "image_id", F.col("pred_idx").alias("other_idx"), F.col("o").alias("o2")), [*group, "other_idx"])
        .select(*group, F.least("o", "o2").alias("hi"), F.greatest("o", "o2").alias("lo"))
    )
    edges = materialise(edges, "edges")
    hot = materialise(_hot_groups(edges, group, fold_limit), "hot")
    dropped = []
    if hot.limit(1).count():
        dropped.append(_drop_by_fold(edges.join(hot, group, "left_anti"), group))
        rest = materialise(edges.join(hot, group, "left_semi"), "rest")
        while rest.limit(1).count():
            waiting = rest.select(*group, F.col("lo").alias("hi")).distinct()
            kept = rest.join(waiting, [*group, "hi"], "left_anti").select(*group, "hi").distinct()
            gone = materialise(rest.join(kept, [*group, "hi"], "left_semi").select(*group, "lo").distinct(), "gone")
            dropped.append(gone)
            rest = materialise(
                rest.join(gone, [*group, "lo"], "left_anti").join(gone.select(*group, F.col("lo").alias("hi")), [*group, "hi"], "left_anti"),
                "rest",
            )
    else:
        dropped.append(_drop_by_fold(edges, group))
    out = dropped[0]
    for d in dropped[1:]:
        out = out.unionByName(d)
    return dets.join(out.select(*group, F.col("lo.p").alias("pred_idx")), key, "left_anti")


def _drop_by_fold(edges: DataFrame, group: list[str]) -> DataFrame:
    lo_type = edges.schema["lo"].dataType.simpleString()

    def step(acc: Column, e: Column) -> Column:
        settled = F.array_contains(acc, e["hi"]) | F.array_contains(acc, e["lo"])
        return F.when(settled, acc).otherwise(F.concat(acc, F.array(e["lo"])))

    return (
        edges.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("a"))
        .select(*group, F.explode(F.aggregate("a", F.array().cast(f"array<{lo_type}>"), step)).alias("lo"))
    )


def missed_gt(gts: DataFrame, matched: DataFrame, models: Sequence[str]) -> DataFrame:
    """Ground truths no prediction of the model matched, with area and inclusive box."""
    base = gts.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    hit = matched.where("is_tp = 1").select("model", "image_id", "gt_idx")
    return base.join(hit, ["model", "image_id", "gt_idx"], "left_anti")
