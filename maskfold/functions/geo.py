"""Georeferencing and ground sampling distance as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounding import half_even

# fixed values: bounds of the region of interest, unit factors, ellipsoid, GSD rules
LAT_BOUNDS = (8.0, 38.0)
LON_BOUNDS = (68.0, 98.0)
METERS_PER_FOOT = 0.3048
METERS_PER_US_SURVEY_FOOT = 1200.0 / 3937.0
EARTH_RADIUS_M = 6371000.0
WGS84_A = 6378137.0
WGS84_E2 = 0.0066943799901413165
PROHIBITED_GSD = (1.0, 0.5, 10.0, 30.0, 0.3)


def geo_flags(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Valid coordinate range, and inside the region of interest."""
    return df.withColumns(
        {
            "is_valid_geo_range": F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0),
            "is_within_bounds": F.col(lat).between(*LAT_BOUNDS) & F.col(lon).between(*LON_BOUNDS),
        }
    )


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    s1, s2 = F.sin(F.radians(lat2 - lat1) / 2.0), F.sin(F.radians(lon2 - lon1) / 2.0)
    a = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return EARTH_RADIUS_M * 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def affine_from_tags(geo: DataFrame) -> DataFrame:
    """Affine (a..f) from the 4 x 4 matrix tag, else from pixel scale and tie point.

    Columns `matrix`, `scale`, `tiepoint` are arrays or null. X = a col + b row + c, Y = d col + e row + f.
    """
    def m(i: int) -> Column:
        return F.try_element_at("matrix", F.lit(i + 1))

    def s(i: int) -> Column:
        return F.try_element_at("scale", F.lit(i + 1))

    def t(i: int) -> Column:
        return F.try_element_at("tiepoint", F.lit(i + 1))

    by_matrix = F.coalesce(F.size("matrix") >= 16, F.lit(False))
    no_matrix = F.col("matrix").isNull()
    by_scale = no_matrix & F.coalesce((F.size("scale") >= 2) & (F.size("tiepoint") >= 6), F.lit(False))
    zero = F.lit(0.0)
    out = geo.withColumns(
        {
            "a": F.when(by_matrix, m(0)).when(by_scale, s(0)),
            "b": F.when(by_matrix, m(1)).when(by_scale, zero),
            "c": F.when(by_matrix, m(3)).when(by_scale, t(3) - t(0) * s(0)),
            "d": F.when(by_matrix, m(4)).when(by_scale, zero),
            "e": F.when(by_matrix, m(5)).when(by_scale, -s(1)),
            "f": F.when(by_matrix, m(7)).when(by_scale, t(4) + t(1) * s(1)),
        }
    )
    skew = by_matrix & ((F.abs("b") > 1e-9) | (F.abs("d") > 1e-9))
    return out.withColumn("is_rotated", F.coalesce(skew, F.lit(False)).cast("int"))


def gsd_from_affine(geo: DataFrame) -> DataFrame:
    """Ground sampling distance, pixel area and status.

    Needs a..f, `crs_kind` ('projected', 'geographic' or null), `map_units`, `width`, `height`. Projected
    scales are converted to metres; degrees use the ellipsoid's radii at the scene centre. No transform, a
    degenerate transform, no CRS or coordinates out of range give null values with a status and a reason.
    """
    det = F.abs(F.col("a") * F.col("e") - F.col("b") * F.col("d"))
    px, py = F.hypot("a", "d"), F.hypot("b", "e")
    units = F.lower("map_units")
    scale = F.when(units.isin("foot", "ft"), METERS_PER_FOOT).when(
        units.isin("us survey foot", "us_survey_foot"), METERS_PER_US_SURVEY_FOOT
    ).otherwise(1.0)
    lat = F.col("d") * F.col("width") / 2.0 + F.col("e") * F.col("height") / 2.0 + F.col("f")
    lon = F.col("a") * F.col("width") / 2.0 + F.col("b") * F.col("height") / 2.0 + F.col("c")
    sin2 = F.pow(F.sin(F.radians(lat)), F.lit(2))
    prime = WGS84_A / F.sqrt(1.0 - WGS84_E2 * sin2)
    meridian = WGS84_A * (1.0 - WGS84_E2) / F.pow(1.0 - WGS84_E2 * sin2, F.lit(1.5))
    absent = F.col("a").isNull() | F.col("e").isNull() | F.col("c").isNull() | F.col("f").isNull()
    case = (
        F.when(absent, "no_transform")
        .when(det <= 1e-15, "singular_transform")
        .when(F.col("crs_kind") == "projected", "projected")
        .when((F.col("crs_kind") == "geographic") & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), "geographic")
        .when(F.col("crs_kind") == "geographic", "coordinates_out_of_range")
        .otherwise("missing_crs")
    )
    out = geo.withColumn("gsd_provenance", case)
    proj, deg = F.col("gsd_provenance") == "projected", F.col("gsd_provenance") == "geographic"
    gx = F.when(proj, px * scale).when(deg, F.radians(px) * prime * F.cos(F.radians(lat)))
    gy = F.when(proj, py * scale).when(deg, F.radians(py) * meridian)
    ok = proj | deg
    return out.withColumns({"gsd_x": gx, "gsd_y": gy}).withColumns(
        {
            "geo_pixel_area_m2": F.when(proj, det * scale * scale).when(deg, F.col("gsd_x") * F.col("gsd_y")),
            "gsd_status": F.when(ok, "VALIDATED").otherwise("INSUFFICIENT_DATA"),
            "is_georeferenced": ok.cast("int"),
        }
    )


def centroid_geo(regions: DataFrame) -> DataFrame:
    """Map coordinates of region centroids; unavailable without an affine transform."""
    has = F.col("a").isNotNull()
    return regions.withColumns(
        {
            "map_x": F.when(has, F.col("a") * F.col("centroid_x") + F.col("b") * F.col("centroid_y") + F.col("c")),
            "map_y": F.when(has, F.col("d") * F.col("centroid_x") + F.col("e") * F.col("centroid_y") + F.col("f")),
            "centroid_status": F.when(has, "available").otherwise("unavailable_no_affine_transform"),
        }
    )


# fixed values: (floor, ceiling, citation length, citation always needed, prohibited values always rejected)
GSD_PROFILES = {
    "calibration": (0.005, 100.0, 8, False, False),
    "provider": (None, 500.0, 10, True, True),
    "resolution": (None, 1000.0, 10, True, True),
}


def gsd_reason(gsd: Column, source: Column, profile: str = "calibration") -> Column:
    """Why a user-supplied GSD is rejected, or null when it is accepted."""
    low, high, cite, always, strict = GSD_PROFILES[profile]
    cited = F.coalesce(F.length(F.trim(source)) >= cite, F.lit(False))
    tol = 1e-5
    banned = F.lit(False)
    for v in PROHIBITED_GSD:
        banned = banned | ((gsd == v) if strict else (F.abs(gsd - v) < tol))
    out = (
        F.when(gsd.isNull(), "gsd_missing")
        .when(F.isnan(gsd) | (F.abs(gsd) == float("inf")), "gsd_not_finite")
        .when(gsd <= 0, "gsd_not_positive")
    )
    if low is not None:
        out = out.when(gsd < low, "gsd_below_plausible")
    if strict:
        out = out.when(banned, "gsd_generic_assumption")
    out = out.when(gsd > high, "gsd_above_plausible")
    if not strict:
        out = out.when(banned & ~cited, "gsd_generic_assumption")
    if always:
        out = out.when(~cited, "gsd_without_citation")
    return out


def resolve_calibration(scenes: DataFrame) -> DataFrame:
    """Embedded metadata wins over a user-supplied GSD, which wins over none.

    Expects the columns of `gsd_from_affine` (null for scenes without tags) and `gsd`, `citation`.
    """
    auto = (F.col("is_georeferenced") == 1) & (F.col("gsd_status") == "VALIDATED") & (F.col("geo_pixel_area_m2") > 0)
    auto = F.coalesce(auto, F.lit(False))
    given = F.col("gsd").isNotNull()
    reason = gsd_reason(F.col("gsd"), F.col("citation"))
    out = scenes.withColumn(
        "calibration_status",
        F.when(auto, "EXTRACTED_METADATA").when(given & reason.isNull(), "USER_SUPPLIED").when(given, "REJECTED").otherwise("UNAVAILABLE"),
    )
    meta, user = F.col("calibration_status") == "EXTRACTED_METADATA", F.col("calibration_status") == "USER_SUPPLIED"
    eff = F.coalesce(F.col("gsd_x"), F.sqrt("geo_pixel_area_m2"))
    return out.withColumns(
        {
            "calibration_type": F.when(auto, "AUTOMATIC").when(given, "MANUAL").otherwise("NONE"),
            "cal_gsd": half_even(F.when(meta, eff).when(user, F.col("gsd")), 4),
            "cal_gsd_x": half_even(F.when(meta, eff).when(user, F.col("gsd")), 4),
            "cal_gsd_y": half_even(F.when(meta, F.coalesce("gsd_y", eff)).when(user, F.col("gsd")), 4),
            "cal_pixel_area_m2": half_even(F.when(meta, F.col("geo_pixel_area_m2")).when(user, F.col("gsd") * F.col("gsd")), 6),
            "rejection_reason": F.when(~auto & given, reason),
            "override_ignored": (auto & given).cast("int"),
        }
    )


def georef_level(is_georeferenced: Column, catalogue_hit: Column) -> Column:
    return F.when(F.coalesce(is_georeferenced, F.lit(False)), "LEVEL_A").when(catalogue_hit, "LEVEL_B").otherwise("UNREFERENCED")


def location_name(
    is_georeferenced: Column, catalogue_hit: Column, within: Column, crs_name: Column, region: str = "Surat, Gujarat, India"
) -> Column:
    """Name shown for a scene: the region inside its bounds, else the CRS, else a catalogue mark."""
    return (
        F.when(catalogue_hit & within, region).when(F.coalesce(is_georeferenced, F.lit(False)), crs_name).when(catalogue_hit, "Catalog Location")
    )
