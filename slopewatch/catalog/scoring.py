"""Queries over the scoring model: classes, components and the whole score."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.catalog.registry import Frames, query
from slopewatch.catalog.views import LEVEL_CASE, RANK_CASE
from slopewatch.functions import basic as B
from slopewatch.functions import scoring as S

D = "cast({} as double)"


def sig(z: str) -> str:
    return f"(1 / (1 + exp(-({z}))))"


def clamp(x: str) -> str:
    return f"(case when ({x}) is null then 0 else greatest(0, least(1, {x})) end)"


def macro(default: float, south: float, central: float, north: float) -> str:
    return f"(case macroregion when 'southern_italy' then {south} when 'central_italy' then {central} when 'northern_italy' then {north} else {default} end)"


ALPHA, BETA = macro(7.190, 8.750, 7.950, 6.370), macro(0.568, 0.645, 0.608, 0.512)
F_ALPHA = macro(4.30, 5.25, 4.75, 3.80)
EXCESS = f"(case when event_mm > 0 then greatest(0, log10(event_mm / event_hours) - log10({ALPHA} * pow(event_hours, -{BETA}))) else 0 end)"
FLOOR_EXCESS = EXCESS.replace(ALPHA, F_ALPHA)
API = f"coalesce({sig('(api_30_mm - coalesce(api_baseline_mm, 80)) / 60')}, 0.5)"
SOIL = f"coalesce({sig('12 * (soil_moisture - 0.30)')}, 0.5)"
SNOW = f"(case when snow_depth_m >= 0.05 then {clamp('rain_24h_mm / 30')} else 0 end)"
CAINE_M = f"(case when sensor_rainfall_mm is not null then {clamp('sensor_rainfall_mm / 2')} else {clamp(EXCESS)} end)"
API_M = f"(case when sensor_pore_kpa is not null then {clamp('sensor_pore_kpa / 60')} else {API} end)"
SOIL_M = f"(case when sensor_soil is not null then {sig('12 * (sensor_soil - 0.30)')} else {SOIL} end)"
STATIC = clamp(
    f"0 * {clamp('susc_ispra')} + 0.375 * {clamp('iffi_density_500 / 8')} + 0.30 * {clamp('slope_deg / 45')}"
    f" + 0.225 * {clamp('pai_class_norm')} + 0.10 * {clamp('litho_weight')}"
)
METEO = clamp(f"0.45 * {CAINE_M} + 0.30 * {API_M} + 0.25 * {SOIL_M} + 0.15 * {SNOW}")
SEISMIC = f"(case when pga_g > 0 then {sig('(pga_g - 0.05) / 0.05')} else 0 end)"
FIRE = "(case when months_since_fire between 0 and 24 then exp(-pow(months_since_fire - 6, 2) / 50) else 0 end)"
PLUVIAL = f"(case when coalesce(flood_rain_72h_mm, 0) <> 0 then {sig(f'(flood_rain_72h_mm - {macro(90, 80, 95, 110)}) / {macro(35, 30, 35, 40)}')} else 0 end)"
FLUVIAL = f"(case when coalesce(discharge_ratio, 0) <> 0 then {sig('(discharge_ratio - 2.0) / 0.8')} else 0 end)"
UPLIFT = f"(case when flood_hazard_norm > 0 then least(1, 0.5 * flood_hazard_norm * greatest({PLUVIAL}, {FLUVIAL}, {clamp('coastal_surge')})) else 0 end)"
HYDRO = clamp(f"{clamp('flood_hazard_norm')} + {UPLIFT}")
V_SCORE = f"coalesce({sig('(velocity_mmd - 5) / 3')}, 0)"
A_SCORE = f"coalesce({sig('(acceleration_mmd2 - 2) / 2')}, 0)"
HARD = "(coalesce(acceleration_mmd2 >= 2, false) or coalesce(inverse_velocity <= 0.10, false))"
ACTIVE = "(velocity_mmd is not null or acceleration_mmd2 is not null or inverse_velocity is not null)"
KIN = f"(case when {HARD} then greatest({V_SCORE}, {A_SCORE}, 0.8) else greatest({V_SCORE}, {A_SCORE}) end)"
BLEND = f"(0.35 * {STATIC} + 0.40 * {METEO} + 0.15 * {SEISMIC} + 0.07 * {FIRE} + 0.03 * {HYDRO})"
TOTAL = clamp(f"case when {ACTIVE} then 0.20 * {KIN} + 0.80 * {BLEND} else {BLEND} end")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def bundle(fx: Frames):
    """Scoring input with the rain excess of its event."""
    b = fx["fx_bundle"]
    return b.withColumn("caine_excess", S.rain_excess(F.col("event_mm"), F.col("event_hours")))


@query("prj1_class_cut", f"select id, {LEVEL_CASE} as level from fx_assess")
def _(fx):
    return fx["fx_assess"].select("id", B.level_of("score").alias("level"))


@query("prj2_level_rank", f"select id, level, {RANK_CASE} as rank, {RANK_CASE} >= 2 as at_least_moderate from fx_rated")
def _(fx):
    return fx["fx_rated"].select("id", "level", B.rank_of("level").alias("rank"), B.at_least("level", "Moderate").alias("at_least_moderate"))


@query("prj3_clamp", "select id, round(case when pga_g is null then 0 else greatest(0, least(1, pga_g * 4)) end, 6) as value from fx_bundle")
def _(fx):
    return fx["fx_bundle"].select("id", r6(B.clamp01(F.col("pga_g") * 4), "value"))


@query("prj4_saturation", f"select cell_id, round({clamp('slope_deg / 45')}, 6) as slope, round({clamp('iffi_density_500 / 8')}, 6) as density from fx_static")
def _(fx):
    return fx["fx_static"].select("cell_id", r6(B.saturated("slope_deg", 45.0), "slope"), r6(B.saturated("iffi_density_500", 8.0), "density"))


@query("prj16_escalated", f"select id, {RANK_CASE} >= 3 or hard_escalation as escalated from fx_rated")
def _(fx):
    return fx["fx_rated"].select("id", (B.at_least("level", "High") | F.col("hard_escalation")).alias("escalated"))


@query("prj17_floor_rescue", f"select id, {FLOOR_EXCESS} > 0 and {SOIL} >= 0.5 as rescued from fx_bundle")
def _(fx):
    excess = S.rain_excess(F.col("event_mm"), F.col("event_hours"), block="rain_floor")
    return fx["fx_bundle"].select("id", S.floor_rescue(excess, F.col("soil_moisture")).alias("rescued"))


@query("sco1_static_component", f"select id, round({STATIC}, 6) as s from fx_bundle")
def _(fx):
    return fx["fx_bundle"].withColumn("_t", S.static_terms()).select("id", r6(S.static_component(F.col("_t")), "s"))


@query("sco2_threshold_intensity", f"select id, round({ALPHA} * pow(event_hours, -{BETA}), 6) as mm_h from fx_bundle")
def _(fx):
    return fx["fx_bundle"].select("id", r6(S.threshold_intensity(F.col("event_hours")), "mm_h"))


@query("sco3_rain_excess", f"select id, round({EXCESS}, 6) as excess from fx_bundle")
def _(fx):
    return bundle(fx).select("id", r6(F.col("caine_excess"), "excess"))


@query("sco4_wetness_factor", f"select id, round({API}, 6) as wetness from fx_bundle")
def _(fx):
    return fx["fx_bundle"].select("id", r6(S.wetness(F.col("api_30_mm"), F.col("api_baseline_mm")), "wetness"))


@query("sco5_rain_on_snow", f"select id, round({SNOW}, 6) as snow from fx_bundle")
def _(fx):
    return fx["fx_bundle"].select("id", r6(S.rain_on_snow(F.col("snow_depth_m"), F.col("rain_24h_mm")), "snow"))


@query("sco6_soil_sigmoid", f"select id, round({SOIL}, 6) as soil from fx_bundle")
def _(fx):
    return fx["fx_bundle"].select("id", r6(S.soil_wetness(F.col("soil_moisture")), "soil"))


@query(
    "sco7_meteo_component",
    f"""select id, round({METEO}, 6) as m,
               concat_ws(',', case when sensor_rainfall_mm is not null then 'caine' end, case when sensor_pore_kpa is not null then 'api' end,
                         case when sensor_soil is not null then 'soil' end) as measured
        from fx_bundle""",
)
def _(fx):
    out = S.score(bundle(fx))
    return out.select("id", r6(F.col("breakdown.m"), "m"), F.array_join("breakdown.meteo_terms.measured", ",").alias("measured"))


@query(
    "sco8_seismic_factor",
    f"""select cell_id, round(pga, 6) as pga, round(case when pga > 0 then {sig('(pga - 0.05) / 0.05')} else 0 end, 6) as e
        from (select cell_id, max(case when magnitude >= 3.5 and age_days between 0 and 7 then pga_g * exp(-age_days / 2) else 0 end) as pga
              from fx_bundle group by cell_id) t""",
)
def _(fx):
    left = S.decayed_pga(F.col("pga_g"), F.col("magnitude"), F.col("age_days"))
    peak = fx["fx_bundle"].groupBy("cell_id").agg(F.max(left).alias("pga"))
    return peak.select("cell_id", r6(F.col("pga"), "pga"), r6(S.seismic_component(F.col("pga")), "e"))


@query("sco9_nominal_pga", "select id, round(greatest(0, least(1, 0.05 * pow(10, (magnitude - 4.5) / 1.5))), 6) as pga from fx_bundle")
def _(fx):
    return fx["fx_bundle"].select("id", r6(S.nominal_pga(F.col("magnitude")), "pga"))


@query(
    "sco10_fire_bell",
    f"""select id, round({FIRE}, 6) as f,
               round(case when greatest(0, date_diff('day', date '1998-01-01', cast(valuation_time as date)) / 30.0) <= 24
                     then greatest(0, date_diff('day', date '1998-01-01', cast(valuation_time as date)) / 30.0) end, 6) as months
        from fx_bundle""",
)
def _(fx):
    months = S.months_since(F.lit("1998-01-01").cast("date"), F.col("valuation_time").cast("date"))
    return fx["fx_bundle"].select("id", r6(S.fire_component(F.col("months_since_fire")), "f"), r6(months, "months"))


@query("sco11_flood_uplift", f"select id, round({UPLIFT}, 6) as uplift, round({HYDRO}, 6) as h from fx_bundle")
def _(fx):
    up = S.flood_uplift(F.col("flood_rain_72h_mm"), F.col("discharge_ratio"), F.col("coastal_surge"), F.col("flood_hazard_norm"))
    return fx["fx_bundle"].select("id", r6(up, "uplift"), r6(S.hydrology_component(F.col("flood_hazard_norm"), up), "h"))


def exposure_sql(alias: str = "") -> dict[str, str]:
    a = alias
    road = f"(case when {a}distance_to_road_m <= 250 then 0.6 when {a}distance_to_road_m <= 1000 then 0.3 else 0 end)"
    rail = f"(case when {a}distance_to_rail_m <= 250 then 0.5 when {a}distance_to_rail_m <= 1000 then 0.25 else 0 end)"
    urban = f"(case when {a}landuse_code like '11%' then 1.0 when {a}near_urban then 0.5 else 0 end)"
    cover = f"(case when {road} + {rail} = 0 then case when {a}landuse_code like '12%' then 0.6 when {a}near_infra then 0.3 else 0 end else 0 end)"
    def tens(d: str) -> str:
        return f"cast(round_even({d} / 10, 0) * 10 as bigint)"

    def dist(d: str) -> str:
        return (f"(case when {d} < 100 then 'meno di 100 m' when {tens(d)} >= 1000 then concat(replace(printf('%.1f', round_even({d} / 1000, 1)), '.', ','), ' km')"
                f" else concat({tens(d)}, ' m') end)")

    tags = f"""concat_ws('; ',
        case when {a}landuse_code like '11%' then 'abitato' when {a}near_urban then 'vicino abitato' end,
        case when {road} > 0 then concat(case when {a}nearest_road_class = 'motorway' then 'autostrada' else 'statale' end, ' a ', {dist(a + 'distance_to_road_m')}) end,
        case when {rail} > 0 then concat('ferrovia a ', {dist(a + 'distance_to_rail_m')}) end,
        case when {road} + {rail} = 0 and {a}landuse_code like '12%' then 'infrastrutture' when {road} + {rail} = 0 and {a}near_infra then 'infrastrutture vicine' end)"""
    return {"factor": f"least(2.0, {urban} + {road} + {rail} + {cover})", "tags": tags}


_EX = exposure_sql()


@query("sco12_exposure", f"select cell_id, round({_EX['factor']}, 6) as factor, {_EX['tags']} as tags from fx_static")
def _(fx):
    from slopewatch.operators.rollup import with_exposure

    out = with_exposure(fx["fx_static"])
    return out.select("cell_id", r6(F.col("exposure.factor"), "factor"), F.array_join("exposure.tags", "; ").alias("tags"))


@query(
    "sco13_kinematic",
    f"select id, {ACTIVE} as active, round(case when {ACTIVE} then {KIN} else 0 end, 6) as k, {ACTIVE} and {HARD} as hard_escalation from fx_bundle",
)
def _(fx):
    t = S.kinematic_terms(F.col("velocity_mmd"), F.col("acceleration_mmd2"), F.col("inverse_velocity"))
    return fx["fx_bundle"].withColumn("_k", t).select("id", F.col("_k.active").alias("active"), r6(F.col("_k.k"), "k"), F.col("_k.hard_escalation").alias("hard_escalation"))


@query(
    "sco14_total_score",
    f"""select id, cell_id, round(score, 6) as score, {LEVEL_CASE} as level, monitored, hard_escalation,
               round(s, 6) as s, round(m, 6) as m, round(e, 6) as e, round(f, 6) as f, round(h, 6) as h, round(k, 6) as k
        from (select id, cell_id, {TOTAL} as score, {ACTIVE} as monitored, {ACTIVE} and {HARD} as hard_escalation,
                     {STATIC} as s, {METEO} as m, {SEISMIC} as e, {FIRE} as f, {HYDRO} as h, case when {ACTIVE} then {KIN} else 0 end as k
              from fx_bundle) t""",
)
def _(fx):
    out = S.score(bundle(fx))
    parts = [r6(F.col(f"breakdown.{c}"), c) for c in "smefhk"]
    return out.select("id", "cell_id", r6(F.col("score"), "score"), "level", "monitored", "hard_escalation", *parts)


@query("sco15_alert_colour", f"select id, case level when 'None' then 'verde' when 'Low' then 'verde' when 'Moderate' then 'gialla' when 'High' then 'arancione' else 'rossa' end as colour from fx_rated")
def _(fx):
    return fx["fx_rated"].select("id", S.alert_colour("level").alias("colour"))


@query(
    "join26_region_parameters",
    f"select id, {ALPHA} * 1.0 as alpha, {BETA} * 1.0 as beta from fx_bundle",
)
def _(fx):
    from slopewatch.operators.relational import lookup_join
    from slopewatch.params import PARAMS

    law = PARAMS["rain_threshold"]
    table = fx.spark.createDataFrame([(k, v["alpha"], v["beta"]) for k, v in law.items()], "macroregion string, a double, b double")
    j = lookup_join(fx["fx_bundle"], table, "macroregion")
    d = law["italy_default"]
    return j.select("id", F.coalesce("a", F.lit(d["alpha"])).alias("alpha"), F.coalesce("b", F.lit(d["beta"])).alias("beta"))


@query("udf1_scorer_by_name", f"select id, round({clamp(EXCESS)}, 6) as rain_only, round({TOTAL}, 6) as fallback from fx_bundle")
def _(fx):
    a = S.score_with(bundle(fx), "rain_threshold").select("id", r6(F.col("score"), "rain_only"))
    b = S.score_with(bundle(fx), "not there").select("id", r6(F.col("score"), "fallback"))
    return a.join(b, "id")


@query("fn1_logistic", f"select id, round({sig('magnitude - 3')}, 6) as value from fx_bundle")
def _(fx):
    return fx["fx_bundle"].select("id", r6(B.logistic(F.col("magnitude") - 3), "value"))
