"""Overlap and matching of masks that occur many times in one image.

Masks of equal shape and place are folded into one shape with a count before anything is paired, so n copies of an
object against m copies cost one pair of shapes, not n * m pairs of masks. Matching keeps predictions apart (they have
scores) but takes ground truths shape by shape: copies are used up in the order of their ids, so it is enough to know
how many are left.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import materialise
from ..plans.ordering import running
from . import images
from .matching import iou_pairs, match_greedy

#: above this many pairs of masks a (model, image) is matched shape by shape
PAIR_LIMIT = 20_000
BLOCK = ("y0", "y1", "x0", "x1")


def fold_shapes(masks: DataFrame, on: Sequence[str], idx: str) -> tuple[DataFrame, DataFrame]:
    """Members (*on, idx, shape) and shapes (*on, shape, n) of masks given as disjoint blocks; a shape is named by its
    smallest member. Masks are equal if their blocks are."""
    on = list(on)
    one = masks.groupBy(*on, idx).agg(F.sort_array(F.collect_list(F.struct(*BLOCK))).alias("blocks"))
    look = F.sha2(F.to_json("blocks"), 256)
    one = materialise(one.select(*on, idx, look.alias("look")), "looks")
    shapes = materialise(one.groupBy(*on, "look").agg(F.min(idx).alias("shape"), F.count("*").alias("n")), "shapes")
    return one.join(shapes.drop("n"), [*on, "look"]).select(*on, idx, "shape"), shapes.select(*on, "shape", "n")


def shape_pairs(dets: DataFrame, gts: DataFrame, det_shapes: DataFrame, gt_shapes: DataFrame, min_iou: float | None = None) -> DataFrame:
    """(model, image_id, pred_shape, gt_shape, n_pred, n_gt, inter, union_px, iou) of all overlapping pairs of shapes."""
    left = dets.join(det_shapes.withColumnRenamed("shape", "pred_idx"), ["model", "image_id", "pred_idx"])
    right = gts.join(gt_shapes.select("image_id", F.col("shape").alias("gt_idx")), ["image_id", "gt_idx"])
    pairs = iou_pairs(left, right, extra=("model", "n"), min_iou=min_iou)
    counts = gt_shapes.select("image_id", F.col("shape").alias("gt_idx"), F.col("n").alias("n_gt"))
    return pairs.join(counts, ["image_id", "gt_idx"]).select(
        "model", "image_id", F.col("pred_idx").alias("pred_shape"), F.col("gt_idx").alias("gt_shape"), F.col("n").alias("n_pred"), "n_gt", "inter", "union_px", "iou"
    )


GROUP = ["model", "image_id"]


def box_pairs(dets: DataFrame, gts: DataFrame, limit: int = images.WALK_LIMIT) -> DataFrame:
    """`shape_pairs` of masks that are one block each. Boxes are folded where their image is dealt to, once, and meet there; images
    with more than `limit` masks a side are folded over the whole cluster and meet by cell."""
    hot = images.crowded(limit, (dets, ["image_id"]), (gts, ["image_id"]))

    def folded(df: DataFrame, on: list[str], idx: str, shape: str, n: str) -> DataFrame:
        rows = images.calm(df, hot).select(*on, idx, "area", *BLOCK).repartition("image_id")
        return rows.groupBy(*on, "area", *BLOCK).agg(F.min(idx).alias(shape), F.count("*").alias(n))

    left, right = folded(dets, ["image_id", "model"], "pred_idx", "pred_shape", "n_pred"), folded(gts, ["image_id"], "gt_idx", "gt_shape", "n_gt")
    right = right.select("image_id", "gt_shape", "n_gt", F.struct("area", *BLOCK).alias("g"))
    left = left.select("image_id", "model", "pred_shape", "n_pred", F.struct("area", *BLOCK).alias("d"))
    met = left.join(right, "image_id").where(images.meet(F.col("d"), F.col("g"))).withColumn("inter", images.overlap(F.col("d"), F.col("g")))
    met = met.withColumn("union_px", F.col("d.area") + F.col("g.area") - F.col("inter")).withColumn("iou", F.col("inter") / F.col("union_px"))
    out = met.select(*GROUP, "pred_shape", "gt_shape", "n_pred", "n_gt", "inter", "union_px", "iou")
    if hot is None:
        return out
    many, truth = (materialise(images.busy(df, hot), "busy") for df in (dets, gts))
    shapes = fold_shapes(many, GROUP, "pred_idx")[1], fold_shapes(truth, ["image_id"], "gt_idx")[1]
    return out.unionByName(shape_pairs(many, truth, *shapes))


def match_boxes(
    dets: DataFrame, gts: DataFrame, iou: float = 0.5, score: str = "score_pct", pair_limit: int = PAIR_LIMIT, limit: int = images.WALK_LIMIT
) -> DataFrame:
    """`match_masks` of masks that are one block each: images with up to `limit` masks a side are walked where they are dealt to,
    only the others are folded."""
    hot = images.crowded(limit, (dets, ["image_id"]), (gts, ["image_id"]))
    out = images.match_calm(dets, gts, hot, iou, score)
    if hot is None:
        return out
    many, truth = (materialise(images.busy(df, hot), "busy") for df in (dets, gts))
    return out.unionByName(match_masks(many, truth, iou, score, pair_limit).select(*out.columns))


def _settle(edges: DataFrame, room: DataFrame, members: DataFrame) -> DataFrame:
    """(model, image_id, pred_idx, o, gt_shape, iou) of each prediction that is matched.

    `edges` (model, image_id, pred_idx, o, gt_shape, iou) lists every shape a prediction may take, `room` (model, image_id, gt_shape,
    left) how many copies there are, `members` (image_id, gt_shape, pos, gt_idx) the copies in order. A prediction takes its best shape
    as soon as fewer predictions than copies left stand before it there: whatever those do, one is left. Equally good
    shapes are told apart by the id of their next copy, which is known once nobody stands before the prediction at any of them.
    All such predictions are settled in one round; the first undecided one always is.
    """
    won: list[DataFrame] = []
    while not edges.isEmpty():
        placed = running(edges, [F.col("o")], by=[*GROUP, "gt_shape"], pos="rank").join(room, [*GROUP, "gt_shape"])
        best = placed.groupBy(*GROUP, "pred_idx").agg(F.max("iou").alias("top"))
        top = materialise(placed.join(best, [*GROUP, "pred_idx"]).where("iou = top"), "top")
        ties = top.groupBy(*GROUP, "pred_idx").agg(F.count("*").alias("n"), F.max("rank").alias("worst"))
        ready = top.join(ties, [*GROUP, "pred_idx"]).where("(n = 1 and rank <= left) or (n > 1 and worst = 1)")
        cols = [*GROUP, "pred_idx", "o", "gt_shape", "iou"]
        now = materialise(ready.select(*cols, "n"), "ready")
        tied = now.where("n > 1")
        taken = now.where("n = 1").select(*cols)
        if not tied.isEmpty():
            # at most one prediction a shape is tied, so the settled ones of a shape are counted for it alone
            used = reduce(DataFrame.unionAll, won) if won else taken.limit(0)
            before = tied.join(used.select(*GROUP, "gt_shape", F.col("o").alias("p")), [*GROUP, "gt_shape"], "left")
            before = before.groupBy(*cols).agg(F.count_if(F.col("p") < F.col("o")).alias("k"))
            heads = before.join(members, ["image_id", "gt_shape"]).where("pos = k + 1")
            pick = heads.groupBy(*GROUP, "pred_idx", "o", "iou").agg(F.min(F.struct("gt_idx", "gt_shape")).alias("m"))
            taken = taken.unionByName(pick.select(*GROUP, "pred_idx", "o", F.col("m.gt_shape").alias("gt_shape"), "iou"))
        taken = materialise(taken, "taken")
        won.append(taken)
        gone = taken.groupBy(*GROUP, "gt_shape").agg(F.count("*").alias("c"))
        room = room.join(gone, [*GROUP, "gt_shape"], "left").select(*GROUP, "gt_shape", (F.col("left") - F.coalesce("c", F.lit(0))).alias("left"))
        room = materialise(room.where(F.col("left") > 0), "room")
        edges = edges.join(taken.select(*GROUP, "pred_idx"), [*GROUP, "pred_idx"], "left_anti")
        edges = materialise(edges.join(room.select(*GROUP, "gt_shape"), [*GROUP, "gt_shape"], "left_semi"), "edges")
    return reduce(DataFrame.unionAll, won) if won else edges


def match_masks(
    dets: DataFrame, gts: DataFrame, iou: float = 0.5, score: str = "score_pct", pair_limit: int = PAIR_LIMIT, det_blocks: DataFrame | None = None
) -> DataFrame:
    """`match_greedy` from the masks themselves: predictions in score order take the best unused ground truth.

    `dets` has one row per prediction; `det_blocks` holds its blocks where it has several (else the row's own box), `gts` is
    blocks with `area`. Images in which copies make more than `pair_limit` pairs of masks are matched shape by shape, all others
    pair by pair; both give what the walk over single masks gives. Adds `gt_idx`, `iou` (null for a miss) and `is_tp`.
    """
    blocks = dets if det_blocks is None else det_blocks
    det_members, det_shapes = fold_shapes(blocks, GROUP, "pred_idx")
    gt_members, gt_shapes = fold_shapes(gts, ["image_id"], "gt_idx")
    pairs = materialise(shape_pairs(blocks, gts, det_shapes, gt_shapes, iou), "shape_pairs")
    load = pairs.groupBy(*GROUP).agg(F.sum(F.col("n_pred") * F.col("n_gt")).alias("load"))
    # bounded by the number of pairs over the limit
    hot = materialise(load.where(F.col("load") > pair_limit).select(*GROUP), "hot")

    def opened(p: DataFrame) -> DataFrame:
        """Predictions of the pairs' shapes, each with the shapes it may take."""
        return p.join(det_members.withColumnRenamed("shape", "pred_shape"), [*GROUP, "pred_shape"])

    cold = opened(pairs.join(hot, GROUP, "left_anti")).join(gt_members.withColumnRenamed("shape", "gt_shape"), ["image_id", "gt_shape"])
    cold = cold.join(dets.select(*GROUP, "pred_idx", score), [*GROUP, "pred_idx"]).select(*GROUP, "pred_idx", score, "gt_idx", "iou")
    if hot.isEmpty():
        return match_greedy(cold, dets, iou, score)
    done = match_greedy(cold, dets.join(hot, GROUP, "left_anti"), iou, score)

    rest = pairs.join(hot, GROUP, "left_semi")
    order: Column = F.struct((-F.col(score)).alias("s"), F.col("pred_idx").alias("p"))
    edges = opened(rest).join(dets.select(*GROUP, "pred_idx", order.alias("o")), [*GROUP, "pred_idx"]).select(*GROUP, "pred_idx", "o", "gt_shape", "iou")
    room = materialise(rest.select(*GROUP, "gt_shape", F.col("n_gt").alias("left")).distinct(), "room")
    used = room.select("image_id", "gt_shape").distinct()
    members = gt_members.withColumnRenamed("shape", "gt_shape").join(used, ["image_id", "gt_shape"], "left_semi")
    members = materialise(running(members, [F.col("gt_idx")], by=["image_id", "gt_shape"]), "members")
    won = materialise(_settle(materialise(edges, "edges"), room, members), "won")
    # the k-th prediction of a shape takes its k-th copy
    seat = running(won, [F.col("o")], by=[*GROUP, "gt_shape"]).join(members, ["image_id", "gt_shape", "pos"]).select(*GROUP, "pred_idx", "gt_idx", "iou")
    many = dets.join(hot, GROUP, "left_semi").join(seat, [*GROUP, "pred_idx"], "left").withColumn("is_tp", F.col("gt_idx").isNotNull().cast("int"))
    return done.unionByName(many)
