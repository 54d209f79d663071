"""Area, energy and avoided CO2. A missing input yields null, a status and reasons, never a default."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounding import half_even

# fixed values: plausible ranges, benchmark parameters, published grid factors
ANNUAL_GHI_RANGE = (500.0, 3500.0)
DAILY_GHI_RANGE = (0.1, 12.0)
EFFICIENCY_RANGE = (0.05, 0.35)
PERFORMANCE_RANGE = (0.40, 1.00)
EMISSION_RANGE = (0.05, 1.50)
MAX_ENERGY_KWH = 100_000_000.0
BENCHMARK_EFFICIENCY = 0.20
BENCHMARK_PERFORMANCE = 0.75
GRID_FACTOR = 0.716
THERMAL_FACTOR = 0.820
DAYS_PER_YEAR = 365.25
FILL_VALUE = -999.0


def daily_unit(unit: Column) -> Column:
    """Whether a unit is kWh per day in some spelling; null is not."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    return u.contains("day") & (u.contains("kwh") | u.contains("kw-hr"))


def annual_ghi(daily: Column, unit: Column) -> Column:
    """Daily irradiation x 365.25, only for per-day kWh units."""
    return F.when(daily_unit(unit), half_even(daily * DAYS_PER_YEAR, 2))


def physical_area(df: DataFrame) -> DataFrame:
    """Panel area in m2 and hectares from `solar_pixels`, `total_pixels` and the calibration columns.

    Order of preference: direct pixel area, x and y GSD, one GSD. Impossible pixel counts raise.
    """
    bad = (F.col("solar_pixels") < 0) | (F.col("total_pixels") <= 0) | (F.col("solar_pixels") > F.col("total_pixels"))
    px = F.when(bad, F.raise_error(F.lit("impossible pixel counts")).cast("bigint")).otherwise(F.col("solar_pixels"))
    def fine(name: str) -> Column:
        return (F.col(name) > 0) & (F.col(name) <= 500.0)

    xy = F.col("cal_gsd_x").isNotNull() & F.col("cal_gsd_y").isNotNull()
    per_px = (
        F.when(F.col("cal_pixel_area_m2") > 0, F.col("cal_pixel_area_m2"))
        .when(xy & fine("cal_gsd_x") & fine("cal_gsd_y"), F.col("cal_gsd_x") * F.col("cal_gsd_y"))
        .when(~xy & fine("cal_gsd"), F.col("cal_gsd") * F.col("cal_gsd"))
    )
    out = df.withColumn("solar_area_m2", half_even(px * per_px, 2))
    return out.withColumns(
        {
            "area_hectares": half_even(F.col("solar_area_m2") / 10000.0, 4),
            "physical_area_status": F.when(F.col("solar_area_m2").isNull(), "insufficient_data").otherwise("calculated"),
        }
    )


def _reasons(*conds: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in conds]), lambda r: r.isNotNull())


def energy(df: DataFrame) -> DataFrame:
    """Annual energy = area x GHI x efficiency x performance ratio, null when any reason applies.

    Uses `solar_area_m2`, `physical_area_status`, `annual_ghi`, `efficiency`, `performance_ratio`. Where `source_daily_ghi`
    and `source_unit` are given, a missing annual value is derived from them, or their unit is a reason of its own.
    """
    g, n, p = F.col("annual_ghi"), F.col("efficiency"), F.col("performance_ratio")
    unit_reason = F.lit(False)
    if {"source_daily_ghi", "source_unit"} <= set(df.columns):
        daily, unit = F.col("source_daily_ghi"), F.col("source_unit")
        unit_reason = g.isNull() & daily.isNotNull() & ~daily_unit(unit)
        df = df.withColumns({"__unit": unit_reason, "annual_ghi": F.coalesce(g, annual_ghi(daily, unit))})
        unit_reason = F.col("__unit")
    reasons = _reasons(
        (F.col("solar_area_m2").isNull() | (F.col("physical_area_status") != "calculated"), "area_unavailable"),
        (unit_reason, "ghi_unit_incompatible"),
        (g.isNull(), "ghi_missing"),
        (~g.between(*ANNUAL_GHI_RANGE), "ghi_implausible"),
        (n.isNull(), "efficiency_missing"),
        (~n.between(*EFFICIENCY_RANGE), "efficiency_implausible"),
        (p.isNull(), "performance_ratio_missing"),
        (~p.between(*PERFORMANCE_RANGE), "performance_ratio_implausible"),
    )
    out = df.withColumn("energy_reasons", reasons).drop("__unit")
    ok = F.size("energy_reasons") == 0
    return out.withColumns(
        {
            "energy_kwh_year": F.when(ok, half_even(F.col("solar_area_m2") * g * n * p, 2)),
            "energy_status": F.when(ok, "estimated").otherwise("insufficient_data"),
        }
    )


def co2(df: DataFrame) -> DataFrame:
    """Avoided CO2 in kg and tonnes from `energy_kwh_year` and `emission_factor`; energy's reasons carry over.

    A factor outside the plausible range is a configuration error and raises. Tonnes come from rounded kg.
    """
    e, f = F.col("energy_kwh_year"), F.col("emission_factor")
    bad = f.isNotNull() & ~f.between(*EMISSION_RANGE)
    factor = F.when(bad, F.raise_error(F.lit("emission factor outside the plausible range")).cast("double")).otherwise(f)
    before = _reasons((F.col("energy_status") != "estimated", "energy_unavailable"))
    own = _reasons((e > MAX_ENERGY_KWH, "energy_implausible"), (f.isNull(), "emission_factor_missing"))
    upstream = F.when(F.col("energy_status") != "estimated", F.col("energy_reasons")).otherwise(F.array().cast("array<string>"))
    # what stopped the energy comes before what is wrong with the factor
    out = df.withColumn("co2_reasons", F.concat(before, upstream, own))
    ok = F.size("co2_reasons") == 0
    out = out.withColumn("co2_kg_year", F.when(ok, half_even(e * factor, 2)))
    return out.withColumns(
        {
            "co2_tonnes_year": half_even(F.col("co2_kg_year") / 1000.0, 4),
            "co2_status": F.when(ok, "estimated").otherwise("insufficient_data"),
        }
    )


def scenarios(efficiency: float | None = None, performance_ratio: float | None = None, emission_factor: float | None = None) -> Column:
    """The five parameter scenarios as an array of structs, to explode beside each scene.

    The arguments are those of the `custom` scenario; what is not given is null there, never a made-up value.
    """
    given = None not in (efficiency, performance_ratio, emission_factor)
    rows = [
        ("unset", None, None, None, "no parameters given"),
        ("benchmark", BENCHMARK_EFFICIENCY, BENCHMARK_PERFORMANCE, None, "benchmark module efficiency and performance ratio"),
        ("grid_average", BENCHMARK_EFFICIENCY, BENCHMARK_PERFORMANCE, GRID_FACTOR, "weighted average grid factor"),
        ("thermal", BENCHMARK_EFFICIENCY, BENCHMARK_PERFORMANCE, THERMAL_FACTOR, "thermal generation factor"),
        ("custom", efficiency, performance_ratio, emission_factor, "user supplied" if given else "not fully supplied"),
    ]
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("scenario"), F.lit(a).cast("double").alias("efficiency"), F.lit(b).cast("double").alias("performance_ratio"),
                F.lit(c).cast("double").alias("emission_factor"), F.lit(s).alias("scenario_source"),
            )
            for n, a, b, c, s in rows
        ]
    )


def readiness(stage: str) -> Column:
    """READY, PARTIALLY_READY or BLOCKED for the area, energy or CO2 stage."""
    area = F.col("physical_area_status") == "calculated"
    if stage == "area":
        ghi = F.col("annual_ghi").isNotNull()
        return F.when(area & ghi, "READY").when(ghi, "PARTIALLY_READY").otherwise("BLOCKED")
    if stage == "energy":
        return F.when(F.col("energy_status") == "estimated", "READY").when(~area, "BLOCKED").otherwise("PARTIALLY_READY")
    return F.when(F.col("co2_status") == "estimated", "READY").when(F.col("energy_status") == "estimated", "PARTIALLY_READY").otherwise("BLOCKED")


def irradiance_reason(ann: Column) -> Column:
    """Why an annual climatology value is rejected, or null."""
    return (
        F.when(ann.isNull(), "ann_missing").when((ann == FILL_VALUE) | (ann < 0), "ann_fill_value")
        .when(~ann.between(*DAILY_GHI_RANGE), "ann_implausible")
    )


def monthly(m: Column) -> Column:
    """Monthly values without the annual entry and without fill values."""
    return F.map_filter(m, lambda k, v: (k != "ANN") & (v != FILL_VALUE))


def cache_key(lat: Column, lon: Column, parameter: str = "ALLSKY_SFC_SW_DWN", basis: str = "climatology") -> Column:
    """Key of a climatology request: coordinates to four places and the first 16 hex digits of a SHA-256."""
    la, lo = F.format_string("%.4f", lat), F.format_string("%.4f", lon)
    raw = F.concat_ws("|", F.lit("NASA_POWER"), la, lo, F.lit(parameter), F.lit(basis))
    return F.concat(F.lit("solar_res_"), la, F.lit("_"), lo, F.lit("_"), F.substring(F.sha2(raw, 256), 1, 16), F.lit(".json"))
