"""Pixel metrics from confusion counts, and their summaries over images."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_even
from ..plans.materialise import materialise
from ..plans.ordering import exact_percentiles

EPS = 1e-7
HEADLINE = ("dice", "iou", "precision", "recall")


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def fg_metrics(conf: DataFrame, empty_gt_recall: float = 0.0) -> DataFrame:
    """Foreground metrics per row of (tp, tn, fp, fn).

    No truth and no prediction counts as perfect. `empty_gt_recall` is the recall of predictions on an
    image without truth: 0.0 by default, 1.0 for the other convention in use.
    """
    tp, tn, fp, fn = _c("tp", "tn", "fp", "fn")
    none = (tp + fn == 0) & (tp + fp == 0)
    total = tp + tn + fp + fn
    return conf.withColumns(
        {
            "dice": F.when(none, 1.0).otherwise(2.0 * tp / (2.0 * tp + fp + fn + EPS)),
            "iou": F.when(none, 1.0).otherwise(tp / (tp + fp + fn + EPS)),
            "precision": F.when(none, 1.0).when(tp + fp > 0, tp / (tp + fp + EPS)).otherwise(0.0),
            "recall": F.when(none, 1.0).when(tp + fn > 0, tp / (tp + fn + EPS)).otherwise(float(empty_gt_recall)),
            "accuracy": (tp + tn) / total,
            "fpr": F.when(tn + fp > 0, fp / (tn + fp + EPS)).otherwise(0.0),
            "fnr": F.when(tp + fn > 0, fn / (tp + fn + EPS)).otherwise(0.0),
        }
    )


def two_class_macro(metrics: DataFrame) -> DataFrame:
    """Mean of foreground and background dice, IoU, precision and recall per image."""
    tn, fp, fn = _c("tn", "fp", "fn")
    bg = {
        "dice": 2.0 * tn / (2.0 * tn + fp + fn + EPS),
        "iou": tn / (tn + fn + fp + EPS),
        "precision": tn / (tn + fn + EPS),
        "recall": tn / (tn + fp + EPS),
    }
    return metrics.withColumns({f"macro_{m}": (F.col(m) + c) / 2.0 for m, c in bg.items()})


def micro(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "micro_dice": 2.0 * tp / (2.0 * tp + fp + fn + EPS),
        "micro_iou": tp / (tp + fp + fn + EPS),
        "micro_precision": tp / (tp + fp + EPS),
        "micro_recall": tp / (tp + fn + EPS),
    }


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols]
    return df.select(*by, F.explode(F.array(*pairs)).alias("s")).select(*by, "s.metric", "s.v")


def micro_macro(
    metrics: DataFrame, by: Sequence[str], pre_round: int | None = None, where: Column | None = None, median: bool = True,
    rollup: bool = False, two_class: bool = False,
) -> DataFrame:
    """Pooled metrics of the summed counts and mean/min/max/population std of the per-image values.

    `two_class` adds the means of the per-image averages over foreground and background (`macro_mean_*`).

    `where` restricts the rows (positive images only), `pre_round` rounds per-image values first,
    `rollup` adds subtotals. The exact median comes from sorted value counts, not from a per-group list.
    """
    df = metrics.where(where) if where is not None else metrics
    if pre_round is not None:
        df = df.withColumns({m: F.round(m, pre_round) for m in HEADLINE})
    macro = [f"macro_{m}" for m in HEADLINE] if two_class else []
    if two_class:
        df = two_class_macro(df)
    if median and not rollup:
        df = materialise(df.select(*by, "tp", "fp", "fn", "tn", *HEADLINE, "accuracy", "fpr", "fnr", *macro), "metrics")
    grouped = df.rollup(*by) if rollup else df.groupBy(*by)
    agg = grouped.agg(
        F.count("*").alias("images"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
        *[F.avg(m).alias(f"mean_{m}") for m in HEADLINE],
        *[F.avg(m).alias(f"mean_{m}") for m in ("accuracy", "fpr", "fnr")],
        *[F.avg(m).alias(f"macro_mean_{m.removeprefix('macro_')}") for m in macro],
        F.min("dice").alias("min_dice"),
        F.max("dice").alias("max_dice"),
        F.stddev_pop("dice").alias("std_dice"),
        F.min("iou").alias("min_iou"),
        F.max("iou").alias("max_iou"),
        *([F.grouping_id().alias("level")] if rollup else []),
    )
    tp, fp, fn = _c("tp", "fp", "fn")
    out = agg.withColumns(micro(tp, fp, fn))
    if median and not rollup:
        med = exact_percentiles(_long(df, HEADLINE, by), "v", {"median": 0.5}, [*by, "metric"])
        med = med.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"median_{m}") for m in HEADLINE])
        out = out.join(med, list(by))
    keep = [*by, *(["level"] if rollup else []), "images", "tp", "fp", "fn", "tn"]
    return out.select(*keep, *[F.round(c, 6).alias(c) for c in out.columns if c not in keep])


def distribution(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, p25, median, p75 and max of each column, long form, exact percentiles."""
    long = materialise(_long(df, cols, by), "long")
    keys = [*by, "metric"]
    base = long.groupBy(*keys).agg(
        F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"),
        F.round(F.min("v"), 6).alias("min"), F.round(F.max("v"), 6).alias("max"),
    )
    p = exact_percentiles(long, "v", {"p25": 0.25, "median": 0.5, "p75": 0.75}, keys)
    return base.join(p.select(*keys, *[F.round(c, 6).alias(c) for c in ("p25", "median", "p75")]), keys)


def generalisation_gap(summary: DataFrame, cols: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Train minus test of each summary column."""
    def pick(c: str, split: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(c)))

    return summary.groupBy(*by).agg(
        *[x for c in cols for x in (
            F.round(pick(c, "train"), 6).alias(f"train_{c}"), F.round(pick(c, "test"), 6).alias(f"test_{c}"),
            F.round(pick(c, "train") - pick(c, "test"), 6).alias(f"gap_{c}"))]
    )


def model_compare(metrics: DataFrame, models: Sequence[str], base: str, cols: Sequence[str] = HEADLINE) -> DataFrame:
    """One row per image, the models' metrics side by side, with differences against `base`."""
    def of(m: str, c: str) -> Column:
        return F.max(F.when(F.col("model") == m, F.col(c)))

    wide = metrics.groupBy("image_id").agg(*[of(m, c).alias(f"{m}_{c}") for m in models for c in cols])
    return wide.select(
        "image_id",
        *[F.round(f"{m}_{c}", 4).alias(f"{m}_{c}") for m in models for c in cols],
        *[F.round(F.col(f"{m}_dice") - F.col(f"{base}_dice"), 4).alias(f"{m}_minus_{base}_dice") for m in models if m != base],
    )


def wide_to_long(wide: DataFrame, models: Sequence[str], cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Columns `<model>_<metric>` to one row per model."""
    structs = [F.struct(F.lit(m).alias("model"), *[F.col(f"{m}_{c}").alias(c) for c in cols]) for m in models]
    return wide.select(*keys, F.explode(F.array(*structs)).alias("s")).select(*keys, "s.*")


def harmonic(a: Column, b: Column) -> Column:
    """2ab / (a + b + eps), 0 when either is not positive."""
    return F.when((a <= 0) | (b <= 0), 0.0).otherwise(2.0 * a * b / (a + b + EPS))


def negative_pixel_rate(conf: DataFrame, images: DataFrame) -> DataFrame:
    """False-positive pixels on negative images over all their pixels, per model."""
    neg = conf.join(images.where("has_solar = 0").select("image_id"), "image_id", "left_semi")
    return neg.groupBy("model").agg(
        F.count("*").alias("images"), F.sum("fp").alias("fp"), F.round(F.sum("fp") / F.sum("total_pixels"), 6).alias("fp_pixel_rate")
    )


def class_metrics(pixels: DataFrame, classes: Sequence[int], ignore: int | None = None) -> DataFrame:
    """Pooled precision, recall, F1, IoU and Dice per class, averaged over classes, with accuracy."""
    df = pixels if ignore is None else pixels.where(F.col("gt") != ignore)
    counts = df.groupBy("gt", "pred").agg(F.count("*").alias("n"))  # classes^2 rows
    per = counts.select("gt", "pred", "n", F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls")).groupBy("cls").agg(
        F.sum(F.when((F.col("gt") == F.col("cls")) & (F.col("pred") == F.col("cls")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("gt") != F.col("cls")) & (F.col("pred") == F.col("cls")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("gt") == F.col("cls")) & (F.col("pred") != F.col("cls")), F.col("n")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("correct"), F.sum("n").alias("total"),
    )
    tp, fp, fn = _c("tp", "fp", "fn")
    p, r = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
    return per.agg(
        F.round(F.max(F.col("correct") / F.greatest(F.col("total"), F.lit(1))), 6).alias("accuracy"),
        F.round(F.avg(p), 6).alias("precision"), F.round(F.avg(r), 6).alias("recall"),
        F.round(F.avg(2 * p * r / (p + r + EPS)), 6).alias("f1"),
        F.round(F.avg(tp / (tp + fp + fn + EPS)), 6).alias("iou"),
        F.round(F.avg(2 * tp / (2 * tp + fp + fn + EPS)), 6).alias("dice"),
        F.round(1.0 - F.avg(2 * tp / (2 * tp + fp + fn + EPS)), 6).alias("dice_loss"),
    )


def dice_loss(pixels: DataFrame, smooth: float = 1.0) -> DataFrame:
    """Soft Dice loss of a two-class map: 1 - mean over classes of (2 sum(p t) + s) / (sum(p) + sum(t) + s)."""
    p, t = F.col("p"), F.col("gt").cast("double")
    s = pixels.agg(
        F.sum(p * t).alias("i1"), F.sum(p + t).alias("c1"), F.sum((1 - p) * (1 - t)).alias("i0"), F.sum((1 - p) + (1 - t)).alias("c0")
    )
    d1 = (2.0 * F.col("i1") + smooth) / (F.col("c1") + smooth)
    d0 = (2.0 * F.col("i0") + smooth) / (F.col("c0") + smooth)
    return s.select(F.round(1.0 - (d0 + d1) / 2.0, 6).alias("dice_loss"))


def coverage_distribution(cov: DataFrame, small: float = 3.0) -> DataFrame:
    """Quartiles and mean of ground-truth coverage, and the share of images at or below `small` percent."""
    cov = materialise(cov.select("coverage_percent"), "coverage")
    q = exact_percentiles(cov, "coverage_percent", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    m = cov.agg(
        F.count("*").alias("images"), F.round(F.avg("coverage_percent"), 4).alias("mean"),
        F.round(F.avg((F.col("coverage_percent") <= small).cast("double")), 6).alias("small_share"),
    )
    return m.join(F.broadcast(q)).select("images", "mean", "small_share", *[half_even(c, 4).alias(c) for c in ("p25", "median", "p75")])


def size_share(objects: DataFrame, limits: Sequence[float] = (0.5, 1.0, 2.0, 5.0)) -> DataFrame:
    """Share of annotations below each percentage of their image's area."""
    pct = F.col("area") / (F.col("width").cast("bigint") * F.col("height")) * 100.0
    return objects.agg(
        F.count("*").alias("annotations"),
        *[F.round(F.avg((pct < x).cast("double")), 6).alias(f"below_{str(x).replace('.', '_')}") for x in limits],
    )


#: chosen cut points: lowest panel count of each tier. The evaluation set names tiers of single images only,
#: so these are a convention of this library; pass others where they are known.
TIERS = ((40, "Very High"), (30, "High"), (20, "High-Medium"), (15, "Medium"), (10, "Median"), (6, "Moderate-Low"), (3, "Low"), (1, "Minimal"))


def density_tier(count: Column, tiers: Sequence[tuple[int, str]] = TIERS, none: str = "Zero-Solar Control") -> Column:
    """Tier of an image by its panel count; `tiers` from the highest to the lowest."""
    out = F.when(count >= tiers[0][0], tiers[0][1])
    for low, name in tiers[1:]:
        out = out.when(count >= low, name)
    return out.otherwise(none)
