"""Queries that run whole jobs end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.catalog.registry import Frames, query
from slopewatch.catalog.rollups import AS_OF_SQL, HIGH, LITHO, STATE, as_of, r6, state
from slopewatch.catalog.scoring import METEO, STATIC, TOTAL, clamp, exposure_sql
from slopewatch.catalog.series import DIV, EVENTS, TRUTH, divergence, truth_table
from slopewatch.catalog.spatial import NORM, OVERLAY, TERRAIN, TOUCH, box_deg, edges, hav
from slopewatch.catalog.views import LEVEL_CASE, RANK_CASE
from slopewatch.functions import basic as B
from slopewatch.operators import evaluation as E
from slopewatch.plans import monitoring as M
from slopewatch.plans import offline as O
from slopewatch.plans import reports as P

FLOOD = clamp("flood_hazard_norm")
RUN_TS = "2024-01-20 00:00:00"
RUN_SQL = f"timestamp '{RUN_TS}'"


def run_ts():
    return F.lit(RUN_TS).cast("timestamp_ntz")


def placed_cells(fx: Frames):
    return fx["fx_cells"].select("cell_id", "aoi_id", "lon", "lat", (F.col("cell_id") % 200).alias("node_id"))


def node_rain(fx: Frames):
    return fx["fx_rain"].withColumnRenamed("series_id", "node_id")


def area_inputs(fx: Frames):
    b = fx["fx_bundle"].join(fx["fx_cells"].select("cell_id", "aoi_id"), "cell_id")
    return b.groupBy("aoi_id").agg(
        F.avg("soil_moisture").alias("soil_moisture"), F.max("snow_depth_m").alias("snow_depth_m"), F.avg("api_30_mm").alias("api_30_mm"),
        F.lit(6.0).alias("event_mm"), F.lit(5.0).alias("event_hours"), F.lit(4.0).alias("rain_24h_mm"),
    )


def run_bundle(fx: Frames):
    return M.assemble(placed_cells(fx), fx["fx_static"], M.rain_features(node_rain(fx), run_ts()), area_inputs(fx))


SLICE = EVENTS.replace("from fx_rain)", f"from fx_rain where ts <= {RUN_SQL} and ts >= {RUN_SQL} - interval 48 hours)")
BUNDLE = f"""{SLICE}, le as (select series_id, total, dur from (select *, row_number() over (partition by series_id order by er desc) as k from g) q where k = 1),
    sums as (select series_id, sum(mm) filter (where ts >= {RUN_SQL} - interval 24 hours) as r24 from fx_rain where ts <= {RUN_SQL} group by series_id),
    ar as (select c.aoi_id, avg(b.soil_moisture) as soil_moisture, max(b.snow_depth_m) as snow_depth_m, avg(b.api_30_mm) as api_30_mm from fx_bundle b join fx_cells c on c.cell_id = b.cell_id group by c.aoi_id),
    bu as (select s.*, c.aoi_id, ar.soil_moisture, ar.snow_depth_m, ar.api_30_mm, case when n.series_id is not null then le.total else 6.0 end as event_mm, case when n.series_id is not null then le.dur else 5.0 end as event_hours,
           case when n.series_id is not null then n.r24 else 4.0 end as rain_24h_mm, null::double as api_baseline_mm, null::double as sensor_rainfall_mm, null::double as sensor_pore_kpa, null::double as sensor_soil, 'italy_default' as macroregion
           from fx_cells c join fx_static s on s.cell_id = c.cell_id left join sums n on n.series_id = c.cell_id % 200 left join le on le.series_id = c.cell_id % 200 join ar on ar.aoi_id = c.aoi_id)"""


@query("sco16_assembled_inputs", f"with {BUNDLE} select cell_id, round(event_mm, 4) as event_mm, round(event_hours, 4) as event_hours, round(rain_24h_mm, 4) as rain_24h_mm, round(soil_moisture, 6) as soil_moisture from bu")
def _(fx):
    b = run_bundle(fx)
    return b.select("cell_id", *[F.round(c, 4).alias(c) for c in ("event_mm", "event_hours", "rain_24h_mm")], r6(F.col("soil_moisture"), "soil_moisture"))


@query("pip1_monitoring_run", f"with {BUNDLE} select cell_id, '24h' as horizon, round({clamp(f'0.35 * {STATIC} + 0.40 * {METEO} + 0.03 * {FLOOD}')}, 6) as score from bu")
def _(fx):
    rows, _ = M.run(run_bundle(fx), run_ts())
    return rows.select("cell_id", "horizon", r6(F.col("score"), "score"))


RUN_SCORE = clamp(f"0.35 * {STATIC} + 0.40 * {METEO} + 0.03 * {FLOOD}")


@query("pip1_alert_candidates", f"""with {BUNDLE}, sc as (select bu.*, {RUN_SCORE} as score, {STATIC} as s_static from bu), lv as (select sc.*, {LEVEL_CASE} as level from sc)
    select cell_id, level, round(score * (1 + {exposure_sql('lv.')['factor']}), 6) as priority from lv where {RANK_CASE} >= 2 and ({RANK_CASE} >= 3 or s_static >= 0.5)""")
def _(fx):
    _, alerts = M.run(run_bundle(fx), run_ts())
    return alerts.select("cell_id", "level", r6(F.col("priority"), "priority")).orderBy(F.desc("priority"), "cell_id")


def ahead(hours: int) -> str:
    """Scores of the run seen from so many hours later."""
    later = BUNDLE.replace(RUN_SQL, f"({RUN_SQL} + interval {hours} hours)")
    return f"select cell_id, '+{hours}h' as horizon, score from (with {later} select cell_id, {RUN_SCORE} as score from bu) q{hours}"


@query("pip2_forecast_sweep", f"select cell_id, horizon, {LEVEL_CASE} as level, round(score, 6) as score from ({' union all '.join(ahead(h) for h in (24, 48, 72))}) t where score >= cast(0.35 as double)")
def _(fx):
    out = M.forecast_sweep(placed_cells(fx), fx["fx_static"], node_rain(fx), area_inputs(fx), run_ts())
    return out.select("cell_id", "horizon", "level", r6(F.col("score"), "score"))


def weight_sql(label: str) -> str:
    clean = f"trim(regexp_replace(lower({label}), '\\s+', ' ', 'g'))"
    return "(case when " + label + " is null then null " + " ".join(f"when {clean} like '%{w}%' then {x}" for w, x in LITHO) + " else 0.5 end)::double"


def nearest_sql(source: str) -> str:
    return f"select c.cell_id, round(least(coalesce(min({hav('c.lon', 'c.lat', 'i.x', 'i.y')}), 50000), 50000), 3) as d from fx_cells c left join {source} i on true group by c.cell_id"


@query("pip3_static_bootstrap", f"""with {TERRAIN}, sl as (select cell_id, avg(slope) as slope_deg, count(z) as n from b group by cell_id),
    den as (select c.cell_id, count(i.id)::double as n from fx_cells c left join fx_inventory i on {box_deg('i.x', 'i.y')} <= {500.0 / 111_320.0!r} group by c.cell_id),
    dist as ({nearest_sql('fx_inventory')}), road as ({nearest_sql("(select * from fx_network where kind = 'road')")}),
    cls as (select cell_id, arg_min(class, (d, class)) as class, min(d) as d from (select c.cell_id, r.class, {hav('c.lon', 'c.lat', 'r.x', 'r.y')} as d from fx_cells c join fx_network r on r.kind = 'road') q group by cell_id),
    pai as (select c.cell_id, max({NORM})::double as norm from fx_cells c left join fx_hazard h on {TOUCH} group by c.cell_id),
    lith as (select cell_id, label from (with {OVERLAY} select cell_id, label, row_number() over (partition by cell_id order by round(area, 12) desc, label) as rn from g where area > 1e-12) t where rn = 1)
    select den.cell_id, den.n as iffi_density_500, dist.d as distance_to_iffi_m, pai.norm as pai_class_norm, {weight_sql('lith.label')} as litho_weight, road.d as distance_to_road_m,
      case when cls.d <= 50000 then cls.class end as nearest_road_class, case when sl.n > 0 then round(sl.slope_deg, 5) end as slope_deg
    from den join dist using (cell_id) join road using (cell_id) left join cls using (cell_id) left join pai using (cell_id) left join lith using (cell_id) left join sl using (cell_id)""")
def _(fx):
    hazards = fx["fx_hazard"].select("geom_id", "hazard_class", "label")
    out = O.static_factors(fx["fx_cells"], fx["fx_inventory"], edges(fx), hazards, fx["fx_network"], fx["fx_faults"], fx["fx_pixels"])
    return out.select("cell_id", "iffi_density_500", F.round("distance_to_iffi_m", 3).alias("distance_to_iffi_m"), "pai_class_norm", "litho_weight", F.round("distance_to_road_m", 3).alias("distance_to_road_m"), "nearest_road_class", F.round("slope_deg", 5).alias("slope_deg"))


@query("pip4_calibration", f"select c.aoi_id, count(susc_ispra) as n, round(corr({STATIC}, susc_ispra), 6) as r from fx_static s join fx_cells c on c.cell_id = s.cell_id where susc_ispra is not null group by c.aoi_id")
def _(fx):
    _, _, fit = O.calibrate(fx["fx_static"], fx["fx_cells"])
    return fit.select("aoi_id", "n", r6(F.col("r"), "r"))


def axis(fx: Frames):
    """Every hour from the first rain sample to the last."""
    from slopewatch.operators.timeseries import hourly_axis

    return hourly_axis(fx["fx_rain"].agg(F.min("ts").alias("start"), F.max("ts").alias("stop")), name="t").select("t")


NODE_HOURS = """t as (select unnest(generate_series(min(ts), max(ts), interval 1 hour)) as t from fx_rain), s as (select r.series_id, t.t, r.ts, r.mm, row_number() over (partition by r.series_id, t.t order by r.ts) as rn from fx_rain r join t on r.ts between t.t - interval 48 hours and t.t),
    w as (select *, case when rn - lag(rn) over (partition by series_id, t order by rn) - 1 >= 6 then 1 else 0 end as ns from s where mm > 0), i as (select *, sum(ns) over (partition by series_id, t order by rn) as ev from w),
    g as (select series_id, t, ev, max(rn) as er, sum(mm) as total, greatest(1.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 + 1.0) as dur from i group by series_id, t, ev having sum(mm) >= 2.0),
    l as (select series_id, t, arg_max(total, er) as total, arg_max(dur, er) as dur from g group by series_id, t),
    nh as (select s.series_id as node_id, s.t, sum(s.mm) filter (where s.ts >= s.t - interval 24 hours) as r24, max(l.total) as event_mm, max(l.dur) as event_hours from s left join l on l.series_id = s.series_id and l.t = s.t group by s.series_id, s.t)"""


@query("pip5_backtest", f"""with {NODE_HOURS}, b as (select s.*, c.cell_id % 200 as node_id, 'italy_default' as macroregion, {', '.join(f'null::double as {c}' for c in (
    'api_30_mm', 'api_baseline_mm', 'soil_moisture', 'snow_depth_m', 'pga_g', 'months_since_fire', 'flood_rain_72h_mm', 'discharge_ratio', 'coastal_surge', 'sensor_rainfall_mm', 'sensor_pore_kpa', 'sensor_soil', 'velocity_mmd', 'acceleration_mmd2', 'inverse_velocity'))}
    from fx_cells c join fx_static s on s.cell_id = c.cell_id),
    al as (select cell_id, min(t) as t, count(*) as n from (select b.cell_id, nh.t, {TOTAL.replace('rain_24h_mm', 'nh.r24')} as score from b join nh on nh.node_id = b.node_id) q where score >= 0.15 group by cell_id),
    e as (select cell_id, min(event_time) as et from fx_slides group by cell_id),
    j as (select (epoch_us(et) - epoch_us(t)) / 3.6e9 as lead, e.cell_id as ec, al.cell_id as ac, n from e full join al on al.cell_id = e.cell_id),
    c as (select count(ec) as events, count(ac) as alerted_cells, cast(coalesce(sum(n), 0) as bigint) as alerts, count(*) filter (where lead > 0 and lead <= 120) as hits, coalesce(avg(lead) filter (where lead > 0 and lead <= 120), 0) as ml from j),
    d as (select *, greatest(0, alerted_cells - hits) as fa from c)
    select events, alerted_cells, alerts, hits, events - hits as misses, fa as false_alarms, round(case when events = 0 then 0 else hits / events end, 6) as hit_rate, round(case when hits + fa = 0 then 0 else fa / (hits + fa) end, 6) as far, round(ml, 6) as mean_lead_h,
           hits / events >= 0.7 and fa / (hits + fa) <= 0.3 and ml >= 18 as accepted from d""")
def _(fx):
    truth = fx["fx_slides"].select("cell_id", "event_time")
    out = O.backtest(placed_cells(fx), fx["fx_static"], node_rain(fx), axis(fx), truth, minimum="Low")
    return out.withColumns({c: F.round(c, 6) for c in ("hit_rate", "far", "mean_lead_h")})


@query("pip5_node_hours", f"with {NODE_HOURS} select node_id, epoch_us(t) as us, round(event_mm, 4) as event_mm, round(event_hours, 4) as event_hours, round(r24, 4) as rain_24h_mm from nh")
def _(fx):
    out = O.node_hours(node_rain(fx), axis(fx))
    return out.select("node_id", B.epoch_us("t").alias("us"), *[F.round(c, 4).alias(c) for c in ("event_mm", "event_hours", "rain_24h_mm")])


@query("pip6_shadow_summary", f"select coalesce(d.aoi_id, t.aoi_id) as aoi_id, d.n as pairs, t.events, t.both_seen from (select aoi_id, count(*) as n from {DIV} v group by aoi_id) d full join (select c.aoi_id, count(*) as events, count(*) filter (where champion is not null and challenger is not null) as both_seen from ({TRUTH}) x join fx_cells c on c.cell_id = x.cell_id group by c.aoi_id) t on t.aoi_id = d.aoi_id")
def _(fx):
    # true for every row; as it reads the values, both passes ask for runs and assessments alike and Spark moves them once
    every = F.hash("id", "d") <= F.lit(2**31 - 1)
    pairs = divergence(fx).filter(every).groupBy("aoi_id").agg(F.count(F.lit(1)).alias("pairs"))
    seen = F.col("champion").isNotNull() & F.col("challenger").isNotNull()
    t = truth_table(fx).join(fx["fx_cells"].select("cell_id", "aoi_id"), "cell_id").groupBy("aoi_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(seen).alias("both_seen"))
    return pairs.join(t, "aoi_id", "full_outer")


@query("pip7_zone_report")
def _(fx):
    manifest, _ = P.zone_report(state(fx), fx["fx_assess"], as_of())
    return manifest.select("build_id", "aoi_id", "zone", "n_cells", r6(F.col("max_score"), "max_score"), "dominant_cell", "diffuse_cells", F.size("trend").alias("trend_points"))


@query("pip9_national_report", f"select count(distinct aoi_id) as regions, count(*) as cells, count(*) filter (where {HIGH}) as high_or_above, count(*) filter (where level = 'Moderate') as moderate, round(max(score), 6) as top_score, (select count(*) from fx_rated where {HIGH} and computed_at >= {AS_OF_SQL} - interval 30 days) as alerts from {STATE} s")
def _(fx):
    recent = fx["fx_rated"].filter(F.col("level").isin("High", "VeryHigh") & (F.col("computed_at") >= as_of() - F.make_dt_interval(days=F.lit(30))))
    out = P.national_report(state(fx), fx["fx_aoi"], fx["fx_runs"], recent, recent.filter(F.col("horizon").startswith("+")))
    return out.select("regions", "cells", "high_or_above", "moderate", r6(F.col("top.score"), "top_score"), "alerts")


EXPORT_NORM = "case h.hazard_class when 'AA' then 0.1 when 'P1' then 0.25 when 'P2' then 0.5 when 'P3' then 0.75 when 'P4' then 1.0 end"


@query("pip11_feature_export", f"""with den as (select c.cell_id, least(count(*) / 3.0, 1.0) as d from fx_cells c join fx_inventory i on {hav('c.lon', 'c.lat', 'i.x', 'i.y')} <= 500 group by c.cell_id),
    pai as (select c.cell_id, max({EXPORT_NORM})::double as norm from fx_cells c join fx_hazard h on {TOUCH} group by c.cell_id)
    select s.cell_id, round(den.d, 6) as iffi_density_500, coalesce(pai.norm, s.pai_class_norm) as pai_class_norm, s.slope_deg from fx_static s left join den using (cell_id) left join pai using (cell_id)""")
def _(fx):
    store = fx["fx_static"].select("cell_id", F.lit(None).cast("double").alias("iffi_density_500"), "pai_class_norm", "slope_deg")
    out = O.feature_export(fx["fx_cells"], fx["fx_inventory"], edges(fx), fx["fx_hazard"], store)
    return out.select("cell_id", r6(F.col("iffi_density_500"), "iffi_density_500"), "pai_class_norm", "slope_deg")


@query("ml3_rain_enrichment", """select e.event_id as id, e.event_id % 4 <> 0 and e.event_time <= timestamp '2024-01-25' as fresh, round(case when e.event_id % 4 <> 0 and e.event_time <= timestamp '2024-01-25' then coalesce(sum(r.mm), 0) else -1 end, 2) as rain_72h_mm
    from fx_slides e left join fx_rain r on r.series_id = e.cell_id % 200 and r.ts between e.event_time - interval 72 hours and e.event_time group by e.event_id, e.event_time""")
def _(fx):
    kind = "struct<rain_24h_mm:double,rain_72h_mm:double,rain_30d_mm:double,max_i_24h_mmh:double,degraded:boolean>"
    known = F.struct(*[F.lit(-1.0).alias(c) for c in ("rain_24h_mm", "rain_72h_mm", "rain_30d_mm", "max_i_24h_mmh")], F.lit(False).alias("degraded")).cast(kind)
    cut = F.lit("2024-01-25").cast("timestamp_ntz")
    past_end = F.col("event_time") > cut
    s = fx["fx_slides"].select(
        F.col("event_id").alias("id"), (F.col("cell_id") % 200).alias("node_id"), F.col("event_time").alias("valuation_time"),
        F.when((F.col("event_id") % 4 == 0) | past_end, known).alias("rain"),
    )
    out = O.enrich_samples(s, node_rain(fx), cut)
    return out.select("id", ((F.col("id") % 4 != 0) & (F.col("valuation_time") <= cut)).alias("fresh"), "rain.rain_72h_mm")


@query("pip10_drift_by_feature", f"select round(abs((select avg(score) from fx_assess where computed_at >= {AS_OF_SQL} - interval 1000 days) - (select avg(score) from fx_assess where computed_at < {AS_OF_SQL} - interval 1000 days)), 6) as pred_drift")
def _(fx):
    cut = as_of() - F.make_dt_interval(days=F.lit(1000))
    a = fx["fx_assess"].withColumnRenamed("score", "v")
    out = E.drift_report(a.filter(F.col("computed_at") < cut), a.filter(F.col("computed_at") >= cut), "v", "v", "v")
    return out.select(r6(F.col("pred_drift"), "pred_drift"))

