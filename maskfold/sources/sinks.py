"""File sinks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import running


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Region, confidence or metric tables as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def report_rows(images: DataFrame, regions: DataFrame, key: str = "image_id", order: str = "label", chunk: int = 10_000) -> DataFrame:
    """Nested reports: an image's columns and the list of its region rows.

    The layout is the same at every size: documents of up to `chunk` regions, each with its `part` number from 0
    and the number of `parts` of its image, at least one. No task gathers more than `chunk` regions.
    """
    cols = [c for c in regions.columns if c != key]
    placed = running(regions, [F.col(order)], [key], pos="__pos").withColumn("part", F.floor((F.col("__pos") - 1) / chunk).cast("int"))
    lists = placed.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("regions"))
    none = F.array().cast(lists.schema["regions"].dataType)
    out = images.join(lists, key, "left")
    n = lists.groupBy(key).agg(F.count("*").cast("int").alias("parts"))
    out = out.join(n, key, "left")
    return out.withColumns({"part": F.coalesce("part", F.lit(0)), "parts": F.coalesce("parts", F.lit(1)), "regions": F.coalesce("regions", none)})


def write_reports(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested reports as JSON lines."""
    df.write.mode(mode).json(path)


def write_prob(pixels: DataFrame, path: str, tile: int = 256, mode: str = "errorifexists") -> None:
    """Probability pixels as Parquet rows of one tile row each: (image_id, y, x0, probs array<float>)."""
    strips = pixels.groupBy("image_id", "y", (F.floor(F.col("x") / tile) * tile).cast("int").alias("x0")).agg(
        F.array_sort(F.collect_list(F.struct("x", F.col("p").cast("float").alias("p")))).alias("a")
    )
    strips.select("image_id", "y", "x0", F.transform("a", lambda s: s["p"]).alias("probs")).write.mode(mode).parquet(path)


def write_splits(df: DataFrame, path: str, by: Sequence[str] = ("split", "dataset_type"), mode: str = "errorifexists") -> None:
    """Each split as its own folder, plus a manifest with the row counts."""
    df.write.mode(mode).partitionBy(*by).parquet(f"{path}/rows")
    df.groupBy(*by).agg(F.count("*").alias("rows")).coalesce(1).write.mode(mode).json(f"{path}/manifest")
