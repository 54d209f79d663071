"""Prediction history: an append-only log and the state that follows from it.

The newest entry of an id wins and a delete is an entry like any other, so writers never rewrite files.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_even
from .schemas import HISTORY

ARRIVAL = ("ingested_at", "ingested_row")


def history_current(log: DataFrame, key: str = "prediction_id", at: str = "persisted_at_utc") -> DataFrame:
    """Current state: the latest entry of each id unless it is a delete.

    The latest is the last to arrive: by `ingested_at`, whatever time the record itself carries, so a back-dated
    replacement replaces. What arrives together goes by `at`, then by `ingested_row`. Logs without these
    columns, and entries where they are null, go by `at` and the remaining columns. A max over the entry as a struct keeps one entry per id and
    combines before the shuffle, so an id with very many versions is no hot spot.
    """
    order = [c for c in (ARRIVAL[0], at, ARRIVAL[1]) if c in log.columns]
    rest = [c for c in log.columns if c not in (key, *order)]
    latest = log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("e")).select(key, "e.*")
    return latest.where("op <> 'delete'").select(*log.columns)


def arrived(batch: DataFrame) -> DataFrame:
    """Stamp when a batch arrives and the order of its rows: what arrives last counts."""
    return batch.withColumns({"ingested_at": F.current_timestamp(), "ingested_row": F.monotonically_increasing_id()})


def valid_entries(batch: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Entries that may be persisted: the id must be present and not empty."""
    return batch.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))


def stamped(batch: DataFrame, op: str, at: str = "persisted_at_utc") -> DataFrame:
    """Mark the operation and stamp the time where it is absent."""
    out = batch.withColumn("op", F.lit(op))
    now = F.current_timestamp()
    return out.withColumn(at, F.coalesce(F.col(at), now) if at in batch.columns else now)


def history_upsert(batch: DataFrame, path: str, key: str = "prediction_id") -> None:
    """Insert or replace by id: append to the log."""
    arrived(stamped(valid_entries(batch, key), "put")).write.mode("append").parquet(path)


def history_delete(log: DataFrame, ids: DataFrame, path: str | None, key: str = "prediction_id") -> DataFrame:
    """Append tombstones for the ids; gives each id with whether it existed."""
    current = history_current(log, key).select(key).withColumn("__hit", F.lit(1))
    asked = ids.select(key).distinct().join(current, key, "left")
    out = asked.select(key, F.col("__hit").isNotNull().cast("int").alias("deleted"))
    if path:
        arrived(stamped(out.where("deleted = 1").select(key), "delete")).write.mode("append").parquet(path)
    return out


def compact(log: DataFrame, path: str, key: str = "prediction_id") -> None:
    """Write the current state to a new place; readers switch when the write is complete."""
    history_current(log, key).write.mode("errorifexists").parquet(path)


def page_newest(current: DataFrame, skip: int = 0, limit: int = 20, order: str = "created_at_utc", key: str = "prediction_id") -> DataFrame:
    """Newest first with skip >= 0 and 1 <= limit <= 100; only skip + limit rows are kept while sorting."""
    skip, limit = max(0, int(skip)), max(1, min(100, int(limit)))
    return current.orderBy(F.col(order).desc(), F.col(key)).offset(skip).limit(limit)


def get_one(current: DataFrame, value, key: str = "prediction_id") -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return current.where(F.col(key) == F.lit(value))


#: columns that the log adds when a record is persisted
LOG_COLUMNS = ("op", "persisted_at_utc", *ARRIVAL)
#: nested details: which columns of an analysed scene each part holds
DETAILS = {
    "area": ("solar_pixels", "total_pixels", "pixel_coverage_percent", "cal_gsd", "cal_gsd_x", "cal_gsd_y", "cal_pixel_area_m2",
             "solar_area_m2", "area_hectares", "physical_area_status"),
    "energy": ("energy_status", "solar_area_m2", "annual_ghi", "efficiency", "performance_ratio", "energy_kwh_year", "energy_reasons"),
    "co2": ("co2_status", "energy_kwh_year", "emission_factor", "co2_kg_year", "co2_tonnes_year", "co2_reasons"),
    "geospatial": ("is_georeferenced", "width", "height", "crs_name", "crs_kind", "map_units", "a", "b", "c", "d", "e", "f", "is_rotated",
                   "gsd_x", "gsd_y", "geo_pixel_area_m2", "gsd_status", "gsd_provenance"),
    "calibration": ("calibration_type", "calibration_status", "cal_gsd", "cal_gsd_x", "cal_gsd_y", "cal_pixel_area_m2", "calibration_source",
                    "rejection_reason"),
}


def history_record(df: DataFrame, model_name: str = "model", threshold: float = 0.5, min_area: int = 0) -> DataFrame:
    """The record of the `HISTORY` contract for each analysed scene, ready for `history_upsert`.

    Takes the columns of the georeferencing, calibration, area, energy and CO2 steps, `prediction_id`, `filename`, `width`, `height`,
    `solar_pixels`, region statistics (`region_count`, `largest_region`, `smallest_region`, `mean_region`) and the place. What `df` lacks is
    null, and a detail that is null is left out of the JSON text; nothing is made up. `model_name`, `threshold` and `min_area` stand where `df`
    has no such column of its own (`applied_threshold`, `applied_min_component_area`).
    """
    types = dict(part.split(" ", 1) for part in (c.strip() for c in HISTORY.split(",")))

    def col(name: str, otherwise: Column | None = None) -> Column:
        return F.col(name) if name in df.columns else F.lit(None) if otherwise is None else otherwise

    automatic = col("calibration_type") == "AUTOMATIC"
    calibrated = col("cal_pixel_area_m2").isNotNull()
    x, y = (half_even(col(f"cal_gsd_{v}").cast("double"), 3) for v in "xy")
    text = F.when(
        calibrated & automatic,
        F.when(x.isNotNull() & y.isNotNull(), F.format_string("%.3fm x %.3fm/px", x, y)).otherwise(
            F.format_string("%.3fm/px", half_even(col("cal_gsd").cast("double"), 3))),
    ).when(calibrated, F.format_string("%.4f m/pixel (User-Supplied)", half_even(col("cal_gsd").cast("double"), 4)))
    manual = F.coalesce(col("calibration_type") == "MANUAL", F.lit(False))
    crs = F.coalesce(col("crs_name"), F.lit("Projected CRS"))
    source = F.when(automatic, F.concat(F.lit("Embedded GeoTIFF ("), crs, F.lit(")"))).when(
        manual & ~calibrated, F.coalesce(F.nullif(col("citation").cast("string"), F.lit("")), F.lit("Rejected user input"))
    ).when(manual, F.trim(col("citation").cast("string"))).otherwise("Unreferenced standard raster without calibration")
    found = col("gsd_provenance").cast("string")
    pixels = F.coalesce(col("total_pixels"), col("width").cast("bigint") * col("height"))
    coverage = half_even(col("solar_pixels") * 100.0 / F.when(pixels > 0, pixels), 4)
    identity = col("prediction_id", F.expr("uuid()")).cast("string")
    values = {
        "prediction_id": identity, "created_at_utc": col("created_at_utc", F.current_timestamp()), "status": F.lit("success"),
        "filename": col("filename"), "model_name": col("model_name", F.lit(model_name)), "image_width": col("width"), "image_height": col("height"),
        "total_image_pixels": pixels, "solar_area_pixels": col("solar_pixels"), "solar_coverage_percent": coverage,
        "detected_region_count": col("region_count"), "largest_region_area_pixels": col("largest_region"),
        "smallest_region_area_pixels": col("smallest_region"), "mean_region_area_pixels": col("mean_region"),
        "physical_area_m2": col("solar_area_m2"), "physical_area_hectares": half_even(col("solar_area_m2") / 10000.0, 4),
        "estimated_energy_kwh_year": col("energy_kwh_year"), "co2_avoided_kg_year": col("co2_kg_year"), "co2_avoided_tonnes_year": col("co2_tonnes_year"),
        "mask_url": F.concat(F.lit("/outputs/"), F.col("prediction_id"), F.lit("/mask")),
        "overlay_url": F.concat(F.lit("/outputs/"), F.col("prediction_id"), F.lit("/overlay")),
        "original_image_url": F.concat(F.lit("/outputs/"), F.col("prediction_id"), F.lit("/original")),
        "applied_threshold": col("applied_threshold", F.lit(threshold)), "applied_min_component_area": col("applied_min_component_area", F.lit(min_area)),
        "gsd_status": F.when(calibrated & automatic, "VALIDATED").when(calibrated, "USER_SUPPLIED").otherwise("UNAVAILABLE"),
        "source_resolution": text, "source_crs": col("crs_name"), "calibration_source": source,
        "metadata_provenance": F.when(calibrated & manual, source).when(calibrated, F.coalesce(found, F.lit("geotiff_embedded_tags"))).otherwise(
            F.coalesce(found, F.lit("unreferenced"))),
        "custom_gsd": F.when(manual, col("cal_gsd")), "calibration_rejection_reason": col("rejection_reason"),
    }
    known = {"pixel_coverage_percent": coverage, "calibration_source": source}
    nested = F.struct(*[
        F.struct(*[known.get(n, col(n, F.lit(None).cast("string"))).alias(n) for n in names]).alias(part)
        for part, names in DETAILS.items()
    ])
    values["details"] = F.to_json(nested)
    first = df.withColumn("prediction_id", identity)  # drawn once, the addresses repeat it
    values["prediction_id"] = F.col("prediction_id")
    return first.select(*[values.get(n, col(n)).cast(t).alias(n) for n, t in types.items() if n not in LOG_COLUMNS])
