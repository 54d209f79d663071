"""Summaries of probability maps and of the regions cut from them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import exact_avg, exact_std, half_even
from ..plans.ordering import exact_percentiles
from .catalogue import must_be_empty
from . import masks
from .masks import region_pixels


def confidence(p: str = "p") -> Column:
    return F.greatest(F.col(p), 1 - F.col(p))


def prob_validate(pixels: DataFrame, tolerance: float = 1e-4, bg: str = "p_bg", fg: str = "p", by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Per map: count of NaN, infinite and out-of-range values and the largest deviation of the class sum from 1."""
    b, f = F.col(bg), F.col(fg)
    inf = F.lit(float("inf"))
    bad_range = (f < -tolerance) | (f > 1 + tolerance) | (b < -tolerance) | (b > 1 + tolerance)
    out = pixels.groupBy(*by).agg(
        F.count_if(F.isnan(f) | F.isnan(b)).alias("nan_count"),
        F.count_if((F.abs(f) == inf) | (F.abs(b) == inf)).alias("inf_count"),
        F.count_if(bad_range).alias("range_count"),
        F.max(F.abs(b + f - 1.0)).alias("max_deviation"),
    )
    ok = (F.col("nan_count") == 0) & (F.col("inf_count") == 0) & (F.col("range_count") == 0) & (F.col("max_deviation") <= tolerance)
    # judged by the exact value, shown rounded
    return out.withColumn("valid", ok.cast("int")).withColumn("max_deviation", F.round("max_deviation", 6))


def require_valid(validated: DataFrame) -> DataFrame:
    """The maps as they are, or an error that names the invalid ones."""
    must_be_empty(validated.where("valid = 0"), "invalid probability maps")
    return validated


def prob_stats(pixels: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Per map: mean, median, min, max and population std of foreground probability on foreground pixels,
    background probability on background pixels, and confidence everywhere; null when a part is empty."""
    parts = F.array(
        F.struct(F.lit("solar").alias("part"), F.when(F.col("pred") == 1, F.col("p")).alias("v")),
        F.struct(F.lit("background").alias("part"), F.when(F.col("pred") == 0, F.round(1 - F.col("p"), 6)).alias("v")),
        F.struct(F.lit("confidence").alias("part"), F.round(confidence(), 6).alias("v")),
    )
    long = pixels.select(*by, F.explode(parts).alias("s")).select(*by, "s.part", "s.v")
    base = long.groupBy(*by, "part").agg(
        F.count("v").alias("n"), exact_avg("v", 4).alias("mean"), half_even(F.min("v"), 4).alias("min"), half_even(F.max("v"), 4).alias("max"),
        exact_std("v", 4).alias("std"),
    )
    med = exact_percentiles(long, "v", {"median": 0.5}, [*by, "part"])
    return base.join(med, [*by, "part"], "left").select(*by, "part", "n", "mean", half_even("median", 4).alias("median"), "min", "max", "std")


def prob_percentiles(pixels: DataFrame, ps: Sequence[float], by: Sequence[str] = (), col: str = "p") -> DataFrame:
    """Listed percentiles (0 to 100) of a probability column, one row each."""
    names = {f"q{i}": p / 100.0 for i, p in enumerate(ps)}
    wide = exact_percentiles(pixels, col, names, by)
    arr = F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.round(f"q{i}", 6).alias("value")) for i, p in enumerate(ps)])
    return wide.select(*by, F.explode(arr).alias("s")).select(*by, "s.*")


def confidence_hist(pixels: DataFrame, bins: int = 10, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Equal-width histogram of confidence per map with the last bin closed; empty bins stay and counts add up."""
    c = F.round(confidence(), 6)
    edges = [F.lit(i / bins) for i in range(bins)]
    inside = [(c >= e) & (c < edges[i + 1]) if i + 1 < bins else c >= e for i, e in enumerate(edges)]
    counts = pixels.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(x).alias(f"b{i}") for i, x in enumerate(inside)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(round(i / bins, 2)).alias("lower_bound"), F.lit(round((i + 1) / bins, 2)).alias("upper_bound"), F.col(f"b{i}").alias("pixel_count"))
        for i in range(bins)
    ])
    return counts.select(*by, "total", F.explode(rows).alias("s")).select(*by, "s.*", half_even(F.col("s.pixel_count") / F.col("total") * 100.0, 2).alias("percentage"))


# fixed values: uneven probability brackets, half open
BRACKETS = ((0.0, 0.05), (0.05, 0.15), (0.15, 0.30), (0.30, 0.50), (0.50, 0.70), (0.70, 0.90), (0.90, 1.001))


def custom_hist(pixels: DataFrame, brackets: Sequence[tuple[float, float]] = BRACKETS, col: str = "p", by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pixels per uneven half-open bracket with percent of the map's pixels."""
    c = F.col(col)
    counts = pixels.groupBy(*by).agg(
        F.count("*").alias("total"), *[F.count_if((c >= lo) & (c < hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(brackets)]
    )
    rows = F.array(*[F.struct(F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"), F.col(f"b{i}").alias("pixel_count")) for i, (lo, hi) in enumerate(brackets)])
    return counts.select(*by, "total", F.explode(rows).alias("s")).select(*by, "s.*", half_even(100.0 * F.col("s.pixel_count") / F.col("total"), 2).alias("percentage"))


def ambiguity(pixels: DataFrame, threshold: float = 0.40, by: Sequence[str] = ()) -> DataFrame:
    """Pixels whose uncertainty reaches the threshold, overall and inside the predicted mask."""
    amb = F.round(1 - F.round(confidence(), 6), 6) >= F.lit(threshold)
    fg = F.col("pred") == 1
    out = pixels.groupBy(*by).agg(
        F.count("*").alias("total_pixels"), F.count_if(fg).alias("solar_pixels"),
        F.count_if(amb).alias("global_ambiguous_pixels"), F.count_if(amb & fg).alias("solar_ambiguous_pixels"),
    )
    return out.select(
        *by, "total_pixels", "solar_pixels", "global_ambiguous_pixels", "solar_ambiguous_pixels",
        half_even(F.col("global_ambiguous_pixels") / F.col("total_pixels") * 100.0, 2).alias("global_ambiguous_percentage"),
        F.when(F.col("solar_pixels") > 0, half_even(F.col("solar_ambiguous_pixels") / F.col("solar_pixels") * 100.0, 2)).otherwise(0.0).alias("solar_ambiguous_percentage"),
    )


def confidence_band(mean_p: Column, high: float = 0.90, medium: float = 0.70) -> Column:
    return F.when(mean_p >= high, "HIGH").when(mean_p >= medium, "MEDIUM").otherwise("LOW")


def region_confidence(labelled: DataFrame, pixels: DataFrame, keys: Sequence[str] = ("image_id",), min_area: int = 1) -> DataFrame:
    """Probability summary and band per region. Probabilities carry six decimals, which bounds the median's state."""
    p = F.col("p")
    conf = F.round(confidence(), 6)
    out = region_pixels(labelled, pixels, keys).groupBy(*keys, "label").agg(
        F.count("*").alias("area"),
        exact_avg("p", 4).alias("mean_probability"),
        F.avg(p.cast("decimal(18,6)")).cast("double").alias("__m"),
        half_even(F.percentile(p, 0.5), 4).alias("median_probability"),
        half_even(F.min(p), 4).alias("min_probability"), half_even(F.max(p), 4).alias("max_probability"),
        exact_std(p, 4).alias("std_probability"),
        exact_avg(conf, 4).alias("mean_confidence"), exact_avg(1 - conf, 4).alias("mean_uncertainty"),
    )
    return out.where(F.col("area") >= min_area).withColumn("band", confidence_band(F.col("__m"))).drop("__m")


def band_summary(regions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and percentages of the three bands."""
    n = F.count("*")
    cols = []
    for band in ("HIGH", "MEDIUM", "LOW"):
        k = F.count_if(F.col("band") == band)
        cols += [k.alias(f"{band.lower()}_count"), F.when(n > 0, half_even(k / n * 100.0, 2)).otherwise(0.0).alias(f"{band.lower()}_percentage")]
    return regions.groupBy(*by).agg(n.alias("total_regions"), *cols)


def region_sweep(
    pixels: DataFrame, maps: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ("image_id", "strategy"), prob: str = "p"
) -> DataFrame:
    """Pixels, coverage and regions (8 neighbours) of each map at each probability threshold.

    `maps` has one row per map: keys, width, height; each keeps a row for every threshold, with zeros where nothing
    passes. Largest and mean size are those of the regions of at least 20 pixels, null without one.
    """
    keys = list(keys)
    ts = F.array(*[F.lit(float(v)) for v in sorted(thresholds)])
    at = [*keys, "threshold"]
    passed = pixels.select(*keys, "y", "x", F.explode(F.filter(ts, lambda v: F.col(prob) >= v)).alias("threshold"))
    regions = masks.region_table(masks.label_runs(masks.pixels_to_runs(passed, at), at), at)
    big = F.when(F.col("area") >= 20, F.col("area"))
    per = regions.groupBy(*at).agg(
        F.sum("area").alias("solar_pixels"), F.count("*").alias("raw_regions"), F.count_if(F.col("area") >= 10).alias("regions_min10"),
        F.count(big).alias("regions_min20"), F.max(big).alias("largest"), half_even(F.avg(big), 2).alias("mean_size"),
    )
    grid = maps.select(*keys, (F.col("width").cast("bigint") * F.col("height")).alias("total"), F.explode(ts).alias("threshold"))
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("solar_pixels", "raw_regions", "regions_min10", "regions_min20")}
    out = grid.join(per, at, "left").withColumns(zero)
    coverage = half_even(F.col("solar_pixels") / F.col("total") * 100.0, 4)
    return out.select(*at, "solar_pixels", coverage.alias("coverage_percent"), "raw_regions", "regions_min10", "regions_min20", "largest", "mean_size")


def roi_stats(pixels: DataFrame, rois: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Probability summary inside boxes [x1, x2) x [y1, y2); rois (keys, roi, x1, y1, x2, y2).

    Boxes are opened to their pixels, so the join is an equi join on (image, y, x).
    """
    cells = rois.select(*keys, "roi", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"), "x1", "x2").select(
        *keys, "roi", "y", F.explode(F.sequence("x1", F.col("x2") - 1)).alias("x")
    )
    return pixels.join(cells, [*keys, "y", "x"]).groupBy(*keys, "roi").agg(
        F.count("*").alias("pixels"), exact_avg("p", 6).alias("mean_p"), F.max("p").alias("max_p"), F.min("p").alias("min_p"),
        F.count_if(F.col("p") >= 0.5).alias("over_half"),
    )
