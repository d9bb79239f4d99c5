"""The explainable multi-factor score as column expressions.

Every builder names its input columns and returns a Column, so a whole scoring
run is one projection: no UDF, no shuffle, whole-stage codegen throughout.
Absent inputs are neutral: 0 for normalised factors, 0.5 for the wetness
sigmoids.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.functions.basic import clamp01, level_of, logistic, lookup, saturated
from slopewatch.params import MACROREGIONS, PARAMS

Params = Mapping[str, Any]
DEFAULT_REGION = "italy_default"


def regional(block: Mapping[str, Any], name: str, macroregion: Column | str = "macroregion") -> Column:
    """Macroregion parameter; unknown regions use the default entry."""
    table = {r: float(block[r][name]) for r in MACROREGIONS if r in block}
    return F.coalesce(lookup(table, macroregion), F.lit(float(block[DEFAULT_REGION][name])))


# --- static ---------------------------------------------------------------
def static_terms(p: Params = PARAMS) -> Column:
    st = p["static"]
    return F.struct(
        clamp01("susc_ispra").alias("susceptibility"),
        saturated("iffi_density_500", st["density_saturation"]).alias("density"),
        saturated("slope_deg", st["slope_saturation"]).alias("slope"),
        clamp01("pai_class_norm").alias("hazard"),
        clamp01("litho_weight").alias("lithology"),
    )


def static_component(terms: Column, p: Params = PARAMS) -> Column:
    weighted = [terms[k] * F.lit(float(w)) for k, w in p["static"]["weights"].items()]
    return clamp01(sum(weighted[1:], weighted[0]))


# --- rain -----------------------------------------------------------------
def threshold_intensity(duration_h: Column, macroregion: Column | str = "macroregion",
                        block: str = "rain_threshold", p: Params = PARAMS) -> Column:
    """Power-law intensity that triggers slides after ``duration_h`` hours.

    A duration that is not positive is an error, as the law has no value there.
    """
    law = regional(p[block], "alpha", macroregion) * F.pow(
        duration_h, -regional(p[block], "beta", macroregion)
    )
    return F.when(duration_h > 0, law).otherwise(
        F.raise_error(F.concat(F.lit("duration must be positive, got "), duration_h.cast("string"))).cast("double")
    )


def rain_excess(total_mm: Column, duration_h: Column, macroregion: Column | str = "macroregion",
                block: str = "rain_threshold", p: Params = PARAMS) -> Column:
    """Decades above the triggering threshold; 0 without an event."""
    usable = total_mm.isNotNull() & (duration_h > 0) & (total_mm > 0)
    alpha, beta = regional(p[block], "alpha", macroregion), regional(p[block], "beta", macroregion)
    log_excess = F.log10(total_mm / duration_h) - F.log10(alpha * F.pow(duration_h, -beta))
    return F.when(usable, F.greatest(F.lit(0.0), log_excess)).otherwise(F.lit(0.0))


def wetness(api_mm: Column, baseline_mm: Column | None = None, p: Params = PARAMS) -> Column:
    base = F.lit(p["api"]["baseline_mm"])
    if baseline_mm is not None:
        base = F.coalesce(baseline_mm, base)
    return F.coalesce(logistic((api_mm - base) / F.lit(p["api"]["sigma_mm"])), F.lit(0.5))


def soil_wetness(moisture: Column, p: Params = PARAMS) -> Column:
    z = F.lit(p["soil"]["steepness"]) * (moisture - F.lit(p["soil"]["center"]))
    return F.coalesce(logistic(z), F.lit(0.5))


def rain_on_snow(depth_m: Column, rain_24h: Column, p: Params = PARAMS) -> Column:
    sn = p["snow"]
    return F.when(
        depth_m >= F.lit(sn["min_depth_m"]), clamp01(F.coalesce(rain_24h, F.lit(0.0)) / sn["rain_scale_mm"])
    ).otherwise(F.lit(0.0))


def meteo_terms(p: Params = PARAMS, sensor: Mapping[str, Column] | None = None) -> Column:
    """Rain, wetness, soil and snow terms; in-situ readings replace the modelled ones."""
    sensor = sensor or {}
    rain, pore, soil = (sensor.get(k) for k in ("rainfall_mm", "pore_pressure_kpa", "soil_moisture"))
    caine = saturated("caine_excess", p["rain_event"]["excess_cap"])
    api = wetness(F.col("api_30_mm"), F.col("api_baseline_mm"), p)
    ground = soil_wetness(F.col("soil_moisture"), p)
    marks = []
    if rain is not None:
        caine = F.when(rain.isNotNull(), clamp01(rain / p["rain_event"]["min_mm"])).otherwise(caine)
        marks.append(F.when(rain.isNotNull(), F.lit("caine")))
    if pore is not None:
        api = F.when(pore.isNotNull(), clamp01(pore / p["api"]["sigma_mm"])).otherwise(api)
        marks.append(F.when(pore.isNotNull(), F.lit("api")))
    if soil is not None:
        ground = F.when(soil.isNotNull(), soil_wetness(soil, p)).otherwise(ground)
        marks.append(F.when(soil.isNotNull(), F.lit("soil")))
    replaced = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    return F.struct(
        F.coalesce(F.col("caine_excess"), F.lit(0.0)).alias("caine_excess"),
        caine.alias("caine"),
        api.alias("api"),
        ground.alias("soil"),
        rain_on_snow(F.col("snow_depth_m"), F.col("rain_24h_mm"), p).alias("snow"),
        replaced.alias("measured"),
    )


def meteo_component(terms: Column, p: Params = PARAMS) -> Column:
    w = p["meteo_weights"]
    return clamp01(
        w["caine"] * terms["caine"]
        + w["api"] * terms["api"]
        + w["soil"] * terms["soil"]
        + p["snow"]["weight"] * terms["snow"]
    )


def floor_rescue(excess_over_floor: Column, moisture: Column, p: Params = PARAMS) -> Column:
    """Rain beyond the permissive line on soil that is wet enough."""
    return (excess_over_floor > 0) & (soil_wetness(moisture, p) >= p["rain_floor"]["wetness_min"])


# --- seismic, fire, water --------------------------------------------------
def nominal_pga(magnitude: Column) -> Column:
    return clamp01(0.05 * F.pow(F.lit(10.0), (magnitude - 4.5) / 1.5))


def decayed_pga(pga: Column, magnitude: Column, age_days: Column, p: Params = PARAMS) -> Column:
    """Ground acceleration left after ``age_days``; 0 outside the look-back."""
    s = p["seismic"]
    counts = (magnitude >= s["min_magnitude"]) & age_days.between(0.0, s["lookback_days"])
    return F.when(counts, pga * F.exp(-age_days / s["tau_days"])).otherwise(F.lit(0.0))


def seismic_component(pga: Column, p: Params = PARAMS) -> Column:
    s = p["seismic"]
    return F.when(pga > 0, logistic((pga - s["threshold_g"]) / s["scale_g"])).otherwise(F.lit(0.0))


def months_since(fire_day: Column, as_of_day: Column, p: Params = PARAMS) -> Column:
    """Months (30 days) since a fire; null once the window has passed."""
    months = F.greatest(F.lit(0.0), F.date_diff(as_of_day, fire_day) / F.lit(30.0))
    return F.when(months <= p["fire"]["max_months"], months)


def fire_component(months: Column, p: Params = PARAMS) -> Column:
    f = p["fire"]
    bell = F.exp(-F.pow(months - f["peak_months"], F.lit(2.0)) / f["denominator"])
    return F.when(months.between(0.0, f["max_months"]), bell).otherwise(F.lit(0.0))


def flood_uplift(rain_72h: Column, ratio: Column, surge: Column, hazard: Column,
                 macroregion: Column | str = "macroregion", p: Params = PARAMS) -> Column:
    """Forecast uplift on hazard ground; a signal of exactly 0 counts as absent."""
    fl = p["flood"]
    pluvial = logistic(
        (rain_72h - regional(fl, "center", macroregion)) / regional(fl, "steepness", macroregion)
    )
    fluvial = logistic((ratio - fl["ratio_center"]) / fl["ratio_steepness"])
    signal = F.greatest(
        F.when(rain_72h != 0, pluvial).otherwise(F.lit(0.0)),
        F.when(ratio != 0, fluvial).otherwise(F.lit(0.0)),
        clamp01(surge),
    )
    return F.when(hazard > 0, F.least(F.lit(1.0), fl["uplift"] * hazard * signal)).otherwise(F.lit(0.0))


def hydrology_component(hazard: Column, uplift: Column) -> Column:
    return clamp01(clamp01(hazard) + uplift)


# --- kinematic -------------------------------------------------------------
def kinematic_terms(velocity: Column, acceleration: Column, inverse_velocity: Column,
                    p: Params = PARAMS) -> Column:
    """Movement factor with its alarm flag; inactive without any movement reading."""
    k = p["kinematic"]
    zero = F.lit(0.0)
    v = F.coalesce(logistic((velocity - k["velocity_center"]) / k["velocity_sigma"]), zero)
    a = F.coalesce(
        logistic((acceleration - k["acceleration_alarm"]) / k["acceleration_alarm"]), zero
    )
    alarm = F.coalesce(acceleration >= k["acceleration_alarm"], F.lit(False)) | F.coalesce(
        inverse_velocity <= k["inverse_velocity_alarm"], F.lit(False)
    )
    value = F.greatest(v, a)
    value = F.when(alarm, F.greatest(value, F.lit(k["escalated_floor"]))).otherwise(value)
    active = F.coalesce(velocity, acceleration, inverse_velocity).isNotNull()
    return F.struct(
        active.alias("active"),
        F.when(active, value).otherwise(zero).alias("k"),
        v.alias("velocity_score"),
        a.alias("acceleration_score"),
        (active & alarm).alias("hard_escalation"),
    )


# --- exposure --------------------------------------------------------------
def distance_text(metres: Column) -> Column:
    """Distance wording: under 100 m, tens of metres, kilometres with a comma."""
    tens = F.bround(metres / 10, 0) * 10
    km = F.concat(F.translate(F.format_string("%.1f", F.bround(metres / 1000, 1)), ".", ","), F.lit(" km"))
    return (
        F.when(metres < 100, F.lit("meno di 100 m"))
        .when(tens >= 1000, km)
        .otherwise(F.concat(tens.cast("long").cast("string"), F.lit(" m")))
    )


def exposure_terms(urban_here: Column, urban_near: Column, infra_here: Column, infra_near: Column,
                   road_m: Column, rail_m: Column, road_class: Column, p: Params = PARAMS) -> Column:
    """What lies below the slope: factor in [0, cap] and its wording."""
    ex = p["exposure"]
    no = F.lit(False)
    here, near = F.coalesce(urban_here, no), F.coalesce(urban_near, no)
    i_here, i_near = F.coalesce(infra_here, no), F.coalesce(infra_near, no)

    def band(distance: Column, kind: str) -> Column:
        return (
            F.when(distance <= ex[f"{kind}_strong_m"], F.lit(ex[f"{kind}_strong"]))
            .when(distance <= ex[f"{kind}_medium_m"], F.lit(ex[f"{kind}_medium"]))
            .otherwise(F.lit(0.0))
        )

    road, rail = band(road_m, "road"), band(rail_m, "rail")
    network = road + rail
    urban = F.when(here, ex["urban_here"]).when(near, ex["urban_near"]).otherwise(0.0)
    cover = F.when(
        network == 0, F.when(i_here, ex["infra_here"]).when(i_near, ex["infra_near"]).otherwise(0.0)
    ).otherwise(0.0)
    road_word = F.when(road_class == "motorway", "autostrada").otherwise("statale")
    tags = F.array_compact(
        F.array(
            F.when(here, F.lit("abitato")).when(near, F.lit("vicino abitato")),
            F.when(road > 0, F.concat(road_word, F.lit(" a "), distance_text(road_m))),
            F.when(rail > 0, F.concat(F.lit("ferrovia a "), distance_text(rail_m))),
            F.when((network == 0) & i_here, F.lit("infrastrutture")).when(
                (network == 0) & i_near, F.lit("infrastrutture vicine")
            ),
        )
    )
    return F.struct(
        F.least(F.lit(ex["cap"]), urban + network + cover).alias("factor"), tags.alias("tags")
    )


def land_flags(code: Column) -> tuple[Column, Column]:
    """(urban, infrastructure) from the land-cover code prefix."""
    return code.startswith("11"), code.startswith("12")


# --- whole score -----------------------------------------------------------
INPUT_COLUMNS = (
    "susc_ispra", "iffi_density_500", "slope_deg", "pai_class_norm", "litho_weight",
    "flood_hazard_norm", "caine_excess", "api_30_mm", "api_baseline_mm", "soil_moisture",
    "snow_depth_m", "rain_24h_mm", "pga_g", "months_since_fire", "flood_rain_72h_mm",
    "discharge_ratio", "coastal_surge", "sensor_rainfall_mm", "sensor_pore_kpa",
    "sensor_soil", "velocity_mmd", "acceleration_mmd2", "inverse_velocity",
)


def with_missing_inputs(df: DataFrame) -> DataFrame:
    """Add absent inputs as nulls so partial bundles can be scored."""
    extra = {c: F.lit(None).cast("double") for c in INPUT_COLUMNS if c not in df.columns}
    if "macroregion" not in df.columns:
        extra["macroregion"] = F.lit(DEFAULT_REGION)
    return df.withColumns(extra) if extra else df


def score(df: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Append ``breakdown``, ``score``, ``level``, ``monitored`` and ``hard_escalation``."""
    df = with_missing_inputs(df)
    w = p["component_weights"]
    sensor = {
        "rainfall_mm": F.col("sensor_rainfall_mm"),
        "pore_pressure_kpa": F.col("sensor_pore_kpa"),
        "soil_moisture": F.col("sensor_soil"),
    }
    terms = df.withColumns(
        {
            "_st": static_terms(p),
            "_mt": meteo_terms(p, sensor),
            "_kt": kinematic_terms(
                F.col("velocity_mmd"), F.col("acceleration_mmd2"), F.col("inverse_velocity"), p
            ),
        }
    ).withColumns(
        {
            "_s": static_component(F.col("_st"), p),
            "_m": meteo_component(F.col("_mt"), p),
            "_e": seismic_component(F.col("pga_g"), p),
            "_f": fire_component(F.col("months_since_fire"), p),
            "_h": hydrology_component(
                F.col("flood_hazard_norm"),
                flood_uplift(
                    F.col("flood_rain_72h_mm"), F.col("discharge_ratio"),
                    F.col("coastal_surge"), F.col("flood_hazard_norm"), p=p,
                ),
            ),
        }
    )
    blend = (
        w["s"] * F.col("_s") + w["m"] * F.col("_m") + w["e"] * F.col("_e")
        + w["f"] * F.col("_f") + w["h"] * F.col("_h")
    )
    wk = p["kinematic"]["weight"]
    total = F.when(F.col("_kt.active"), wk * F.col("_kt.k") + (1 - wk) * blend).otherwise(blend)
    out = terms.withColumn("score", clamp01(total)).withColumns(
        {
            "level": level_of("score", p["class_bounds"]),
            "monitored": F.col("_kt.active"),
            "hard_escalation": F.col("_kt.hard_escalation"),
            "breakdown": F.struct(
                F.col("_s").alias("s"), F.col("_m").alias("m"), F.col("_e").alias("e"),
                F.col("_f").alias("f"), F.col("_h").alias("h"), F.col("_kt.k").alias("k"),
                F.col("_st").alias("static_terms"), F.col("_mt").alias("meteo_terms"),
                F.col("_kt").alias("kinematic_terms"),
            ),
        }
    )
    return out.drop("_st", "_mt", "_kt", "_s", "_m", "_e", "_f", "_h")


def rain_only_score(df: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Baseline that uses nothing but the rain threshold."""
    df = with_missing_inputs(df)
    out = df.withColumn("score", saturated("caine_excess", p["rain_event"]["excess_cap"]))
    return out.withColumn("level", level_of("score", p["class_bounds"]))


SCORERS = {"deterministic": score, "rain_threshold": rain_only_score}


def score_with(df: DataFrame, name: str, p: Params = PARAMS, **extra: Any) -> DataFrame:
    """Scorer chosen by name; an unknown or unavailable one falls back to the full model."""
    scorer = {**SCORERS, **extra}.get(name) or score
    return scorer(df, p)


def alert_colour(level: Column | str, p: Params = PARAMS) -> Column:
    return lookup(p["alert_colour"], level)


def hazard_norm(cls: Column, ladder: str = "operational", p: Params = PARAMS) -> Column:
    """Severity of a hazard class on one of the two ladders; null when unknown."""
    return lookup(p["hazard_norm"][ladder], F.upper(F.trim(cls)))


def lithology_weight(label: Column, p: Params = PARAMS) -> Column:
    """First table entry contained in the cleaned label decides."""
    from slopewatch.functions.text import collapse

    clean = collapse(label)
    out = None
    for word, weight in p["lithology_weight"].items():
        hit = clean.contains(word)
        out = F.when(hit, weight) if out is None else out.when(hit, weight)
    return out.otherwise(F.lit(p["lithology_default"]))
