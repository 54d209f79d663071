"""Scene catalogue joins, gates and audits."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import base_name, parse_sample_id
from ..plans.materialise import materialise


class GateError(ValueError):
    """A data gate found rows that must not exist: `offenders` has all of them, `count` is their number."""

    def __init__(self, message: str, offenders: DataFrame | None = None, count: int = 0) -> None:
        super().__init__(message)
        self.offenders, self.count = offenders, count


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail at plan time with the list of missing columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise GateError(f"missing columns: {missing}")
    return df


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def must_be_empty(df: DataFrame, what: str, show: int = 20) -> None:
    """Raise when `df` has any row. The error carries the whole table and its size; only its text is cut to `show` rows."""
    rows = df.limit(show).collect()
    if rows:
        n = df.count()
        raise GateError(f"{what}, {n} rows: {[tuple(r) for r in rows]}{' ...' if n > show else ''}", df, n)


def catalogue(coords: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest joined to coordinates on sampleid; the engine chooses broadcast or shuffle by size."""
    return manifest.join(coords, "sampleid")


def lookup(files: DataFrame, cat: DataFrame) -> DataFrame:
    """Catalogue row by file name, else by the id parsed from the name, else null.

    The catalogue is one row per sampleid and per file name.
    """
    by_name = cat.select(base_name(F.col("filename")).alias("__name"), F.col("sampleid").alias("name_sid"))
    by_id = cat.select(F.col("sampleid").cast("string").alias("__key"), F.col("sampleid").alias("id_sid"))
    out = files.withColumn("__name", base_name(F.col("filename"))).join(by_name, "__name", "left")
    parsed = F.when(F.col("name_sid").isNull(), parse_sample_id(F.col("filename")).cast("string"))
    # rows that need no second look-up get a key that matches nothing and still spreads: nulls would all
    # land in one partition
    out = out.withColumn("__key", F.coalesce(parsed, F.concat(F.lit("#"), F.col("__name")))).join(by_id, "__key", "left")
    return out.withColumn("sampleid", F.coalesce("name_sid", "id_sid")).drop("__name", "__key", "name_sid", "id_sid")


def attach_annotations(images: DataFrame, ann: DataFrame) -> DataFrame:
    """Images with their annotation count and total annotated area; none counts as 0."""
    per = ann.groupBy("image_id").agg(F.count("*").alias("annotation_count"), F.sum("area").alias("annotated_area"))
    zero = F.lit(0).cast("bigint")
    return images.join(per, "image_id", "left").withColumns(
        {"annotation_count": F.coalesce("annotation_count", zero), "annotated_area": F.coalesce("annotated_area", zero)}
    )


def join_exactly_one(ids: DataFrame, files: DataFrame, key: str = "sampleid") -> tuple[DataFrame, DataFrame]:
    """Ids with exactly one file, and the offenders with their file count (see `files_of` for their files)."""
    per = files.groupBy(key).agg(F.count("*").alias("n_files"), F.min("filename").alias("filename"))
    joined = ids.join(per, key, "left").withColumn("n_files", F.coalesce("n_files", F.lit(0).cast("bigint")))
    joined = materialise(joined, "files")  # a row per id, read by both frames
    return joined.where("n_files = 1").drop("n_files"), joined.where("n_files <> 1").select(key, "n_files")


def files_of(offenders: DataFrame, files: DataFrame, key: str = "sampleid") -> DataFrame:
    """One row per offender and file, with null for an offender without files: lists of any length."""
    return offenders.join(files.select(key, "filename"), key, "left").select(key, "n_files", "filename")


def require_one_to_one(ids: DataFrame, files: DataFrame, key: str = "sampleid") -> DataFrame:
    """Ids with their one file; raises `GateError` with the offenders and their files if an id has none or several."""
    good, bad = join_exactly_one(ids, files, key)
    offenders = materialise(files_of(bad, files, key), "offenders")
    n = offenders.select(key).distinct().count()
    if n:
        first = offenders.orderBy(key, "filename").first()
        raise GateError(f"{n} ids without exactly one file, such as {first[key]} with {first.n_files}", offenders, n)
    return good


def protect(df: DataFrame, protected: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows in the protected list, and the rest."""
    names = protected.select(key).distinct()
    return df.join(names, key, "left_semi"), df.join(names, key, "left_anti")


def bounds_audit(scenes: DataFrame) -> DataFrame:
    """Coordinate extremes and the number of scenes outside the region of interest."""
    return scenes.agg(
        F.count("*").alias("total_samples"), F.min("latitude").alias("min_latitude"), F.max("latitude").alias("max_latitude"),
        F.min("longitude").alias("min_longitude"), F.max("longitude").alias("max_longitude"),
        F.count_if(~F.col("is_within_bounds")).alias("anomaly_count"),
    )


def anomalies(scenes: DataFrame) -> DataFrame:
    """The scenes outside the region of interest."""
    return scenes.where(~F.col("is_within_bounds")).select("sampleid", "filename", "latitude", "longitude", "has_solar")


def match_audit(looked_up: DataFrame) -> DataFrame:
    """Files matched and unmatched to the catalogue, and the georeferencing level this gives."""
    hit = F.col("sampleid").isNotNull()
    return looked_up.agg(
        F.count("*").alias("images"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched")
    ).withColumn("georeferencing_level", F.when(F.col("matched") > 0, "LEVEL_B").otherwise("UNREFERENCED"))


def attach_irradiance(scenes: DataFrame, irr: DataFrame) -> DataFrame:
    """Climatology by coordinates rounded to four places; scenes outside the region get none."""
    key = F.format_string("%.4f|%.4f", "latitude", "longitude")
    # scenes outside get a key that matches nothing and still spreads over the partitions
    inside = F.when(F.col("is_within_bounds"), key).otherwise(F.concat(F.lit("#"), key))
    return scenes.withColumn("cell", inside).join(irr, "cell", "left")


def valid_annotations(ann: DataFrame, polygons: str = "segmentation") -> DataFrame:
    """Drop annotations without area, crowd annotations, and polygons of fewer than three points; no `iscrowd` means 0."""
    kept = F.filter(polygons, lambda p: F.size(p) >= 6)
    return ann.where((F.col("area") > 0) & (F.coalesce("iscrowd", F.lit(0)) != 1)).withColumn(polygons, kept).where(F.size(polygons) > 0)


def normalise_mask(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Images whose values lie in {0, 255} are scaled to {0, 1}; any other value is an error.

    One summary row per image decides, so no image is gathered anywhere.
    """
    v = F.col(value)
    gate = pixels.groupBy("image_id").agg(
        F.max((v == 255).cast("int")).alias("has_255"), F.max((v == 1).cast("int")).alias("has_1"),
        F.max((~v.isin(0, 1, 255)).cast("int")).alias("other"),
    )
    bad = (F.col("other") == 1) | ((F.col("has_255") == 1) & (F.col("has_1") == 1))
    fixed = F.when(bad, F.raise_error(F.concat(F.lit("mask values are not binary in image "), F.col("image_id").cast("string"))).cast("int")).otherwise((v > 0).cast("int"))
    return pixels.join(gate, "image_id").withColumn(value, fixed).drop("has_255", "has_1", "other")
