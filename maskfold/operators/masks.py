"""Masks as sparse tables.

Two shapes are used, both listing foreground only:
  runs   (keys, y, x0, x1)          one stretch of a row, half open in x
  blocks (keys, y0, y1, x0, x1)     a rectangle of equal rows, half open in both directions
A run is a block of height one. Work is cut by image cell, so the largest unit a task must hold is
bounded by the cell and not by the image.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.rounding import exact_avg, half_even
from ..plans.materialise import materialise

CELL = 256
LABEL_STRIDE = 1 << 31


def binarise(pixels: DataFrame, threshold: float = 0.5, prob: str = "p") -> DataFrame:
    """Foreground pixels: probability at or above the threshold; null and NaN are background."""
    return pixels.where((F.col(prob) >= threshold) & ~F.isnan(prob))


def keep_area(masks: DataFrame, least: float) -> DataFrame:
    """Masks or annotations of at least `least` pixels."""
    return masks.where(F.col("area") >= least)


def runs_to_blocks(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stack equal stretches of consecutive rows into blocks (gaps and islands per column range)."""
    w = Window.partitionBy(*keys, "x0", "x1").orderBy("y")
    return (
        runs.withColumn("__g", F.col("y") - F.row_number().over(w))
        .groupBy(*keys, "x0", "x1", "__g")
        .agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
        .select(*keys, "y0", "y1", "x0", "x1")
    )


def blocks_to_runs(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per image row of each block."""
    return blocks.select(*keys, F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1")


def to_cells(blocks: DataFrame, cell_w: int = CELL, cell_h: int = CELL) -> DataFrame:
    """Cut blocks at cell borders and add the cell (cy, cx), the equi-join key of all overlap joins."""
    def span(lo: str, hi: str, size: int) -> Column:
        return F.sequence(F.floor(F.col(lo) / size).cast("int"), F.floor((F.col(hi) - 1) / size).cast("int"))

    cut = blocks.withColumn("cy", F.explode(span("y0", "y1", cell_h))).withColumn("cx", F.explode(span("x0", "x1", cell_w)))
    return cut.withColumns(
        {
            "y0": F.greatest("y0", F.col("cy") * cell_h),
            "y1": F.least("y1", (F.col("cy") + 1) * cell_h),
            "x0": F.greatest("x0", F.col("cx") * cell_w),
            "x1": F.least("x1", (F.col("cx") + 1) * cell_w),
        }
    )


WORD, SLAB = 64, 32


def _packed(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Foreground as a bit raster: per 64 x 32 cell one 64-bit word for each row (`r0` ... `r31`).

    OR-ing words counts overlaps once and has a fixed-size state, so copies and piled-up objects collapse
    before the shuffle; the first `distinct` spreads copies of one block over all tasks.
    """
    cells = to_cells(blocks.select(*keys, "y0", "y1", "x0", "x1").distinct(), WORD, SLAB)
    cells = cells.select(
        *keys, "cy", "cx", (F.col("y0") - F.col("cy") * SLAB).alias("ya"), (F.col("y1") - F.col("cy") * SLAB).alias("yb"),
        F.expr(f"shiftleft(shiftrightunsigned(-1L, cast({WORD} - (x1 - x0) as int)), cast(x0 - cx * {WORD} as int))").alias("word"),
    )
    rows = [F.bit_or(F.expr(f"if(ya <= {i} and {i} < yb, word, 0L)")).alias(f"r{i}") for i in range(SLAB)]
    return cells.groupBy(*keys, "cy", "cx").agg(*rows)


def covered_area(blocks: DataFrame, keys: Sequence[str], name: str = "area") -> DataFrame:
    """Pixels covered per `keys`, overlaps counted once."""
    ones = sum([F.bit_count(f"r{i}") for i in range(1, SLAB)], F.bit_count("r0"))
    return _packed(blocks, keys).groupBy(*keys).agg(F.sum(ones.cast("bigint")).alias(name))


def flatten_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlapping blocks to disjoint runs covering the same pixels (cut at 64-column words)."""
    words = _packed(blocks, keys).select(*keys, "cy", "cx", F.posexplode(F.array(*[f"r{i}" for i in range(SLAB)])).alias("i", "bits")).where("bits <> 0")
    starts = "filter(sequence(0, 63), i -> (shiftright(bits, i) & 1L) = 1L and (i = 0 or (shiftright(bits, i - 1) & 1L) = 0L))"
    ends = "filter(sequence(0, 63), i -> (shiftright(bits, i) & 1L) = 1L and (i = 63 or (shiftright(bits, i + 1) & 1L) = 0L))"
    return words.select(
        *keys, (F.col("cy") * SLAB + F.col("i")).cast("int").alias("y"), "cx", F.explode(F.arrays_zip(F.expr(starts).alias("s"), F.expr(ends).alias("e"))).alias("r")
    ).select(
        *keys, "y", (F.col("cx") * WORD + F.col("r.s")).cast("int").alias("x0"), (F.col("cx") * WORD + F.col("r.e") + 1).cast("int").alias("x1")
    )


def pixels_to_runs(pixels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Foreground pixels (keys, y, x) to runs, cut at every 1024th column.

    The window sees one image row inside one stripe, so it never holds more than 1024 pixels. Runs that
    meet at a stripe border stay apart here; coverage does not mind and `label_runs` joins them.
    """
    stripe = F.floor(F.col("x") / 1024)
    w = Window.partitionBy(*keys, "y", "__s").orderBy("x")
    runs = (
        pixels.select(*keys, "y", "x").withColumn("__s", stripe)
        .withColumn("__g", F.col("x") - F.row_number().over(w))
        .groupBy(*keys, "y", "__s", "__g")
        .agg(F.min("x").cast("int").alias("x0"), (F.max("x") + 1).cast("int").alias("x1"))
    )
    return runs.select(*keys, F.col("y").cast("int").alias("y"), "x0", "x1")


def coverage(area: DataFrame, images: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Foreground, background and total pixels with coverage percent; images without a mask count as empty."""
    total = F.col("width").cast("bigint") * F.col("height")
    fg = F.coalesce(F.col("area"), F.lit(0)).cast("bigint")
    return images.join(area, list(keys), "left").select(
        *keys,
        fg.alias("solar_pixels"),
        (total - fg).alias("background_pixels"),
        total.alias("total_pixels"),
        F.when(total > 0, half_even(fg / total * 100.0, 4)).otherwise(0.0).alias("coverage_percent"),
    )


def mask_bbox(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inclusive bounding box per mask."""
    return blocks.groupBy(*keys).agg(
        F.min("x0").cast("bigint").alias("bbox_x1"),
        F.min("y0").cast("bigint").alias("bbox_y1"),
        (F.max("x1") - 1).cast("bigint").alias("bbox_x2"),
        (F.max("y1") - 1).cast("bigint").alias("bbox_y2"),
    )


# ---------------------------------------------------------------- connected components


def _meetings(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of touching runs among runs sorted by (y, x0): each with the stretch of runs it meets in the row above,
    found by two binary searches, and with its left neighbour if they adjoin."""
    row, width = y - y[0], int(x1.max() - x0.min()) + 2
    left, right = x0 - x0.min(), x1 - x0.min()
    starts, ends, above = row * width + left, row * width + right, (row - 1) * width
    first = np.searchsorted(ends, above + left, "left" if reach else "right")
    last = np.searchsorted(starts, above + right, "right" if reach else "left")
    n = np.maximum(last - first, 0)
    own = np.repeat(np.arange(len(y)), n)
    met = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    side = np.flatnonzero((y[1:] == y[:-1]) & (x0[1:] <= x1[:-1]))
    return np.concatenate([own, side + 1]), np.concatenate([met, side])


def _contract(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes: roots hook on smaller roots, paths are halved, edges inside
    one group fall away."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _label_tile(connectivity: int):
    """Runs of one tile with their component label, the row-major number of the component's first pixel."""

    def run(t: pa.Table) -> pa.Table:
        y, x0, x1 = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        order = np.lexsort((x1, x0, y))
        y, x0, x1 = y[order], x0[order], x1[order]
        root = _contract(len(y), *_meetings(y, x0, x1, 1 if connectivity == 8 else 0))
        label = np.empty(len(y), np.int64)
        label[order] = (y * LABEL_STRIDE + x0)[root]  # sorted by (y, x0), so the smallest node has the first pixel
        return t.append_column("label", pa.array(label))

    return run


def label_runs(
    runs: DataFrame, keys: Sequence[str] = ("image_id",), connectivity: int = 8, tile: int = 1024
) -> DataFrame:
    """Connected components (4 or 8 neighbours): every run with its component `label`.

    Runs are the nodes of a graph; runs that touch in neighbouring rows are joined tile by tile in one shuffle, and a
    tile bounds what a task holds (at most tile * tile / 2 runs). Only when some image spans several tiles are the
    labels that meet at tile borders joined by `merge_labels`. Runs of a row must not overlap; they may adjoin.
    """
    keys = list(keys)
    cut = to_cells(runs.select(*keys, F.col("y").alias("y0"), (F.col("y") + 1).alias("y1"), "x0", "x1"), tile, tile)
    cut = cut.select(*keys, F.col("cy").cast("int").alias("cy"), F.col("cx").cast("int").alias("cx"), F.col("y0").cast("int").alias("y"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))
    schema = StructType([*cut.schema.fields, StructField("label", LongType())])
    swept = cut.groupBy(*keys, "cy", "cx").applyInArrow(_label_tile(connectivity), schema)
    swept = materialise(swept, "tiles")
    if not swept.where("cy > 0 or cx > 0").limit(1).count():
        return swept.drop("cy", "cx")
    edges = _border_edges(swept, keys, connectivity, tile)
    roots = merge_labels(edges, keys)
    return swept.join(roots, [*keys, "label"], "left").select(
        *keys, "y", "x0", "x1", F.coalesce("root", "label").alias("label")
    )


def _border_edges(swept: DataFrame, keys: list[str], connectivity: int, tile: int) -> DataFrame:
    """Pairs of tile labels that touch across a tile border."""
    reach = 1 if connectivity == 8 else 0
    side = swept.where((F.col("x0") % tile == 0) | (F.col("x1") % tile == 0))
    left = side.where(F.col("x1") % tile == 0).select(
        *keys, F.col("x1").alias("x"), F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach)).alias("y"), F.col("label").alias("a")
    )
    right = side.where(F.col("x0") % tile == 0).select(*keys, F.col("x0").alias("x"), "y", F.col("label").alias("b"))
    across = left.join(right, [*keys, "x", "y"]).select(*keys, "a", "b")

    def columns(df: DataFrame, name: str) -> DataFrame:
        # 64-column bins keep the join an equi join along a border row
        lo, hi = F.floor((F.col("x0") - 1) / 64), F.floor(F.col("x1") / 64)
        return df.select(*keys, "y", F.col("x0").alias(f"{name}0"), F.col("x1").alias(f"{name}1"), F.col("label").alias(name), F.explode(F.sequence(lo, hi)).alias("bin"))

    upper = columns(swept.where(F.col("y") % tile == tile - 1).withColumn("y", F.col("y") + 1), "a")
    lower = columns(swept.where((F.col("y") % tile == 0) & (F.col("y") > 0)), "b")
    meet = (F.col("a0") < F.col("b1") + reach) & (F.col("b0") < F.col("a1") + reach)
    down = upper.join(lower, [*keys, "y", "bin"]).where(meet).select(*keys, "a", "b")
    return across.unionAll(down).where("a <> b").select(
        *keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def merge_labels(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest label of each connected group of labels, by repeated min-label and pointer jumping.

    Each round is written to the shared folder; rounds grow with the log of the longest chain.
    """
    keys = list(keys)
    edges = materialise(edges, "edges")
    both = edges.unionAll(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.select(*keys, F.col("a").alias("v"), F.col("a").alias("root")).distinct(), "labels")
    while True:
        nbr = both.join(labels.select(*keys, F.col("v").alias("b"), "root"), [*keys, "b"])
        low = nbr.groupBy(*keys, F.col("a").alias("v")).agg(F.min("root").alias("low"))
        hooked = labels.join(low, [*keys, "v"]).select(*keys, "v", "root", F.least("root", "low").alias("next"))
        hooked = materialise(hooked, "hooked")
        # the root of a root's own hook: min over all members shortens chains in one step
        pulled = hooked.groupBy(*keys, F.col("root")).agg(F.min("next").alias("pull"))
        jumped = hooked.join(pulled, [*keys, "root"]).select(*keys, "v", F.col("root").alias("old"), F.least("next", "pull").alias("mid"))
        target = hooked.select(*keys, F.col("v").alias("mid"), F.col("next").alias("far"))
        new = materialise(
            jumped.join(target, [*keys, "mid"], "left").select(
                *keys, "v", F.least("mid", F.coalesce("far", "mid")).alias("root"), "old"
            ),
            "labels",
        )
        changed = new.where("root <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels.select(*keys, F.col("v").alias("label"), "root")


def region_table(labelled: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per component: area, bounding box and centroid."""
    n = (F.col("x1") - F.col("x0")).cast("bigint")
    sum_x = n * (F.col("x0") + F.col("x1") - 1) / 2
    return labelled.groupBy(*keys, "label").agg(
        F.sum(n).alias("area"),
        F.min("x0").cast("bigint").alias("x"),
        F.min("y").cast("bigint").alias("y"),
        (F.max("x1") - F.min("x0")).cast("bigint").alias("width"),
        (F.max("y") + 1 - F.min("y")).cast("bigint").alias("height"),
        F.round(F.sum(sum_x) / F.sum(n), 6).alias("centroid_x"),
        F.round(F.sum(n * F.col("y")) / F.sum(n), 6).alias("centroid_y"),
    )


def component_stats(
    regions: DataFrame, images: DataFrame, min_area: int = 20, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Raw and filtered region statistics per image; images without regions keep null sizes and 100 % retained.

    Region areas are whole numbers bounded by the image, so the median state holds at most one entry
    per distinct area.
    """
    keep = F.col("area") >= min_area
    got = regions.groupBy(*keys).agg(
        F.count("*").alias("raw_count"),
        F.count_if(keep).alias("filtered_count"),
        F.max(F.when(keep, F.col("area"))).alias("largest_area"),
        F.min(F.when(keep, F.col("area"))).alias("smallest_area"),
        half_even(F.avg(F.when(keep, F.col("area"))), 2).alias("mean_area"),
        half_even(F.percentile(F.when(keep, F.col("area")), 0.5), 2).alias("median_area"),
        F.sum("area").alias("raw_pixels"),
        F.sum(F.when(keep, F.col("area")).otherwise(0)).alias("filtered_pixels"),
    )
    zero = ["raw_count", "filtered_count", "raw_pixels", "filtered_pixels"]
    out = images.join(got, list(keys), "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in zero})
    return out.select(
        *keys,
        "raw_count",
        "filtered_count",
        "largest_area",
        "smallest_area",
        "mean_area",
        "median_area",
        "raw_pixels",
        "filtered_pixels",
        F.when(F.col("raw_pixels") > 0, half_even(F.col("filtered_pixels") / F.col("raw_pixels") * 100.0, 2)).otherwise(100.0).alias("retained_percent"),
        half_even(F.col("filtered_count") / (F.col("width") * F.col("height")), 8).alias("region_density"),
    )


def region_pixels(labelled: DataFrame, pixels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Attach each pixel to its region: runs are opened to pixels, so the join is a plain equi join."""
    opened = labelled.select(*keys, "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "label")
    return pixels.drop("label").join(opened, [*keys, "y", "x"])


def confusion(
    gt: DataFrame, pred: DataFrame, images: DataFrame, models: Sequence[str] | DataFrame, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Pixel confusion per model and image without touching background pixels.

    Ground truth and predictions are packed to bit words once each and meet by cell: the common bits are the
    true positives, and true negatives follow from width x height.
    """
    keys = list(keys)
    names = F.array(*[F.lit(m) for m in models])
    words = [f"r{i}" for i in range(SLAB)]

    def ones(*bits: Column) -> Column:
        return sum([F.bit_count(b) for b in bits[1:]], F.bit_count(bits[0])).cast("bigint")

    g = _packed(gt, keys)
    p = _packed(pred, ["model", *keys])
    gt_area = g.groupBy(*keys).agg(F.sum(ones(*map(F.col, words))).alias("g"))
    beside = g.select(*keys, "cy", "cx", *[F.col(r).alias(f"g_{r}") for r in words])
    common = ones(*[F.coalesce(F.col(r).bitwiseAND(F.col(f"g_{r}")), F.lit(0).cast("bigint")) for r in words])
    by_model = p.join(beside, [*keys, "cy", "cx"], "left").groupBy("model", *keys).agg(
        F.sum(ones(*map(F.col, words))).alias("p"), F.sum(common).alias("tp")
    )
    zero = F.lit(0).cast("bigint")
    base = images.select(*keys, "width", "height", F.explode(names).alias("model"))
    joined = base.join(gt_area, keys, "left").join(by_model, ["model", *keys], "left").select(
        "model",
        *keys,
        (F.col("width").cast("bigint") * F.col("height")).alias("total"),
        F.coalesce("g", zero).alias("g"),
        F.coalesce("p", zero).alias("p"),
        F.coalesce("tp", zero).alias("tp"),
    )
    return counted(joined, keys)


def counted(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The confusion counts from pixels in all (`total`), of the ground truth (`g`), of the prediction (`p`) and of both (`tp`)."""
    return pixels.select(
        "model",
        *keys,
        "tp",
        (F.col("total") - F.col("g") - F.col("p") + F.col("tp")).alias("tn"),
        (F.col("p") - F.col("tp")).alias("fp"),
        (F.col("g") - F.col("tp")).alias("fn"),
        F.col("total").alias("total_pixels"),
        F.col("g").alias("gt_pixels"),
        F.col("p").alias("pred_pixels"),
        (F.col("p") - F.col("g")).alias("pixel_diff"),
    )


def component_errors(
    gt: DataFrame, pred: DataFrame, images: DataFrame, min_area: int = 15, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Missed and false components between two labelled run tables (keys, y, x0, x1, label)."""
    keys = list(keys)

    def opened(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), F.col("label").alias(name))

    def counted(own: DataFrame, other: DataFrame, total: str, lost: str) -> DataFrame:
        # each own pixel looks for any pixel of the other mask at its place
        seen = opened(own, "label").join(opened(other, "o"), [*keys, "y", "x"], "left")
        comps = seen.groupBy(*keys, "label").agg(F.count("*").alias("area"), F.count("o").alias("hits")).where(F.col("area") >= min_area)
        return comps.groupBy(*keys).agg(F.count("*").alias(total), F.count_if(F.col("hits") == 0).alias(lost))

    out = images.select(*keys).join(counted(gt, pred, "gt_components", "missed"), keys, "left")
    out = out.join(counted(pred, gt, "pred_components", "false_components"), keys, "left")
    names = ["gt_components", "pred_components", "missed", "false_components"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in names})
    ratio = (
        F.when(F.col("gt_components") > 0, F.round(F.col("pred_components") / F.col("gt_components"), 6))
        .when(F.col("pred_components") == 0, 1.0)
        .otherwise(999.0)
    )
    return out.select(*keys, *names, ratio.alias("component_ratio"))


def instances(labelled: DataFrame, pixels: DataFrame, prob: str, min_area: int = 8, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Candidate instances: regions of at least `min_area` pixels, scored by their mean probability."""
    return (
        region_pixels(labelled, pixels, keys)
        .groupBy(*keys, "label")
        .agg(F.count("*").alias("area"), exact_avg(prob, 6).alias("score"))
        .where(F.col("area") >= min_area)
    )


def largest_regions(regions: DataFrame, n: int = 15, min_area: int = 20, by: str = "image_id") -> DataFrame:
    """The `n` largest regions of each image among those of at least `min_area` pixels; ties by label."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("area").desc(), "label"))
    return regions.where(F.col("area") >= min_area).withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
