"""Text, id and file checks as column expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: file-name patterns, upload limits and units
SAMPLE_ID_PATTERN = r"(?i)^(\d+)(?:\.0)?_1(?:\.0)?(?:_benchmark)?\.(?:png|jpg|jpeg)$"
STEM_ID_PATTERN = r"(?i)^(\d+)\.(?:png|jpg|jpeg)$"
STRIP_PATTERN = r"^PV01_([^_]+)_[^.]*?(?:_label)?(?:\.[A-Za-z]+)?$"
UUID4_PATTERN = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
ALLOWED_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
MAX_FILE_BYTES = 50 * 1024 * 1024


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parse_sample_id(filename: Column) -> Column:
    """`768.0_1.0.png`, `0960_1.png`, `100.png` to the number in front; anything else to null."""
    name = base_name(filename)
    found = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (SAMPLE_ID_PATTERN, STEM_ID_PATTERN)]
    return F.coalesce(*found).try_cast("bigint")


def parse_strip(filename: Column, strict: bool = False) -> Column:
    """Flight-strip number of `PV01_<strip>_<frame>[_label].<ext>`; null (or an error) otherwise."""
    got = F.nullif(F.regexp_extract(base_name(filename), STRIP_PATTERN, 1), F.lit(""))
    if not strict:
        return got
    return F.when(got.isNull(), F.raise_error(F.concat(F.lit("no strip in file name: "), filename)).cast("string")).otherwise(got)


def valid_uuid4(col: Column) -> Column:
    """Whether the id reads as a UUID."""
    return F.coalesce(col.rlike(UUID4_PATTERN), F.lit(False))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def landing_quarantine(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Add `reject_reason`: unsupported extension, empty, or above the size limit; null for good files."""
    reason = (
        F.when(~extension(F.col(path)).isin(*ALLOWED_EXTENSIONS), "unsupported_extension")
        .when(F.col(length) == 0, "empty_file")
        .when(F.col(length) > MAX_FILE_BYTES, "too_large")
    )
    return files.withColumn("reject_reason", reason)


def unit_ok(unit: Column, allowed: Sequence[str]) -> Column:
    """Case- and space-insensitive membership of a unit name."""
    def norm(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(c)), " ", "")

    return norm(unit).isin(*[a.strip().lower().replace(" ", "") for a in allowed])


def route_strategy(w: Column, h: Column) -> Column:
    """How an image of this size is scored: direct, tiled or letterbox."""
    return (
        F.when((w == 256) & (h == 256), "direct").when((w == h) & (w <= 640), "direct")
        .when(F.greatest(w, h) > 640, "tiled").otherwise("letterbox")
    )


def keep_labels(df: DataFrame, labels: Sequence, col: str = "label") -> DataFrame:
    """Rows whose label is in the accepted list (ambiguous labels drop out)."""
    return df.where(F.col(col).isin(*labels))


def numeric_coerce(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text that is not a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls become the column's exact median, the mean of the two middle values; a column of nulls stays null."""
    from ..plans.ordering import exact_percentiles

    for c in cols:
        middle = exact_percentiles(df.select(c), c, {"__median": 0.5})  # one row
        df = df.join(F.broadcast(middle), how="left").withColumn(c, F.coalesce(c, "__median")).drop("__median")
    return df
