"""Queries over the latest state: roll-ups, rankings, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slopewatch.catalog.registry import Frames, query
from slopewatch.catalog.scoring import exposure_sql
from slopewatch.catalog.views import RANK_CASE
from slopewatch.functions import basic as B
from slopewatch.functions import scoring as S
from slopewatch.operators import relational as R
from slopewatch.operators import rollup as U

AS_OF = "2001-08-01 00:00:00"
AS_OF_SQL = f"timestamp '{AS_OF}'"
LATEST = "(select * from (select *, row_number() over (partition by cell_id order by computed_at desc, id desc) as rn from fx_rated) t0 where rn = 1)"
STATE = f"(select l.*, c.aoi_id, c.istat_code, c.lon, c.lat from {LATEST} l join fx_cells c on c.cell_id = l.cell_id)"
EXPO = exposure_sql("st.")["factor"]
HIGH = "level in ('High', 'VeryHigh')"
COUNTS = ", ".join(f"count(*) filter (where level = '{n}') as n_{n.lower()}" for n in ("None", "Low", "Moderate", "High", "VeryHigh")) + f", count(*) filter (where {HIGH}) as n_alert"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def state(fx: Frames):
    """Latest assessment per cell with the cell's place and administrative unit."""
    return U.latest_state(fx["fx_rated"]).join(fx["fx_cells"].select("cell_id", "aoi_id", "istat_code", "lon", "lat"), "cell_id")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# --- windows -------------------------------------------------------------------
@query("win1_latest_per_cell", f"select cell_id, id, level, round(score, 6) as score, epoch_us(computed_at) as computed_us from {LATEST} l")
def _(fx):
    return U.latest_state(fx["fx_rated"]).select("cell_id", "id", "level", r6(F.col("score"), "score"), B.epoch_us("computed_at").alias("computed_us"))


@query("win1_latest_observed", "select cell_id, id from (select *, row_number() over (partition by cell_id order by computed_at desc, id desc) as rn from fx_rated where horizon not like '+%') t where rn = 1")
def _(fx):
    return U.latest_state(fx["fx_rated"], observed_only=True).select("cell_id", "id")


@query(
    "win3_state_hours_ago",
    f"""select cell_id, id, round(score, 6) as score from (select *, row_number() over (partition by cell_id order by computed_at desc, id desc) as rn
        from fx_rated where computed_at <= {AS_OF_SQL} - interval 8760 hours) t where rn = 1""",
)
def _(fx):
    return U.state_as_of(fx["fx_rated"], as_of(), 8760).select("cell_id", "id", r6(F.col("score"), "score"))


@query("udf2_state_function", f"""select c.aoi_id, count(*) as n, round(max(t.score), 6) as max_score from (select *, row_number() over (partition by cell_id order by computed_at desc, id desc) as rn
        from fx_rated where computed_at <= {AS_OF_SQL} - interval 4380 hours) t join fx_cells c on c.cell_id = t.cell_id where rn = 1 group by c.aoi_id""")
def _(fx):
    past = U.state_as_of(fx["fx_rated"], as_of(), 4380)
    return past.join(fx["fx_cells"].select("cell_id", "aoi_id"), "cell_id").groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max("score"), "max_score"))


@query(
    "win6_cell_trend",
    f"""select cell_id, kind, count(*) as n, round(avg(score), 6) as mean_score, min(us) as first_us, max(us) as last_us from (
          select cell_id, 'observed' as kind, score, epoch_us(computed_at) as us from fx_assess where horizon not like '+%' and computed_at >= {AS_OF_SQL} - interval 17520 hours
          union all
          select cell_id, 'forecast', score, epoch_us(computed_at + interval 48 hours) from fx_assess where horizon like '+%') t
        group by cell_id, kind""",
)
def _(fx):
    from slopewatch.operators.timeseries import trend

    t = trend(fx["fx_assess"], as_of(), hours=17520).withColumn("us", B.epoch_us("t"))
    return t.groupBy("cell_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("score"), "mean_score"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )


# --- filters and projections ------------------------------------------------------
@query("prj5_optional_filter", "select cell_id from fx_cells where aoi_id = 'aoi-2'")
def _(fx):
    return R.optional_filter(fx["fx_cells"], aoi_id="aoi-2", istat_code=None).select("cell_id")


@query("prj6_trailing_filter", f"select id from fx_assess where computed_at >= {AS_OF_SQL} - interval 2160 hours")
def _(fx):
    return fx["fx_assess"].filter(F.col("computed_at") >= as_of() - F.make_dt_interval(hours=F.lit(2160))).select("id")


@query("prj7_forecast_split", "select horizon like '+%' as forecast, pipeline_version like 'v1-forecast+%' as by_version, count(*) as n from fx_assess group by all")
def _(fx):
    return fx["fx_assess"].groupBy(
        F.col("horizon").startswith("+").alias("forecast"), F.col("pipeline_version").startswith("v1-forecast+").alias("by_version")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("prj8_land_flags", "select cell_id, landuse_code like '11%' as urban, landuse_code like '12%' as infra from fx_static")
def _(fx):
    urban, infra = S.land_flags(F.col("landuse_code"))
    return fx["fx_static"].select("cell_id", urban.alias("urban"), infra.alias("infra"))


@query("prj9_json_path", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.q') is not null as has_q from events")
def _(fx):
    v = F.try_parse_json("props")
    return fx["events"].select(
        "event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.q", "string").isNotNull().alias("has_q")
    )


@query("prj10_json_merge", """select event_id, '{"k":"' || json_extract_string(props, '$.k') || '","rain":"' || case when value > 50 then 'wet' else 'dry' end || '"}' as merged from events""")
def _(fx):
    base = F.from_json("props", "map<string,string>")
    rain = F.create_map(F.lit("rain"), F.when(F.col("value") > 50, "wet").otherwise("dry"))
    return fx["events"].select("event_id", F.to_json(F.map_concat(base, rain)).alias("merged"))


@query("prj11_hazard_ladders", """select geom_id, case hazard_class when 'AA' then 0.2 when 'P1' then 0.4 when 'P2' then 0.6 when 'P3' then 0.8 when 'P4' then 1.0 end::double as operational,
        case hazard_class when 'AA' then 0.10 when 'P1' then 0.25 when 'P2' then 0.50 when 'P3' then 0.75 when 'P4' then 1.0 end::double as export from fx_hazard""")
def _(fx):
    c = F.col("hazard_class")
    return fx["fx_hazard"].select("geom_id", S.hazard_norm(c).alias("operational"), S.hazard_norm(c, "export").alias("export"))


LITHO = [("argille", 0.85), ("flysch", 0.80), ("complesso caotico", 0.85), ("scisti", 0.75), ("sabbie", 0.65), ("limi", 0.65), ("tufi", 0.60),
         ("marne", 0.70), ("alluvioni", 0.55), ("conglomerati", 0.50), ("calcari", 0.30), ("dolomie", 0.30), ("graniti", 0.20), ("gneiss", 0.25), ("vulcaniti", 0.40)]
RAW_LITHO = "concat(' ', upper(p_type), '  ', case p_partkey % 8 when 0 then 'Argille  marnose' when 1 then 'FLYSCH' when 2 then 'Complesso   caotico' when 3 then 'calcari' when 4 then 'Tufi e sabbie' when 5 then 'gneiss' else 'altro' end)"


@query("prj12_lithology_weight", "select p_partkey, (case " + " ".join(f"when t like '%{w}%' then {x}" for w, x in LITHO) + f" else 0.5 end)::double as weight, t as label from (select p_partkey, trim(regexp_replace(lower({RAW_LITHO}), '\\s+', ' ', 'g')) as t from part) q")
def _(fx):
    from slopewatch.functions.text import collapse

    raw = F.expr(RAW_LITHO)
    return fx["part"].select("p_partkey", S.lithology_weight(raw).alias("weight"), collapse(raw).alias("label"))


@query("prj13_bbox_intersects", "select geom_id from fx_hazard where cx - rx <= 10.2 and cx + rx >= 10.05 and cy - ry <= 38.15 and cy + ry >= 38.03")
def _(fx):
    from slopewatch.functions.geo import bbox_intersects

    box = (F.col("cx") - F.col("rx"), F.col("cy") - F.col("ry"), F.col("cx") + F.col("rx"), F.col("cy") + F.col("ry"))
    frame = tuple(F.lit(v) for v in (10.05, 38.03, 10.2, 38.15))
    return fx["fx_hazard"].filter(bbox_intersects(box, frame)).select("geom_id")


@query("prj14_inventory_query", "select i.id, i.movement_code, r.r_name as label from fx_inventory i left join region r on r.r_regionkey = i.label where i.x between 10.05 and 10.6 and i.y between 38.0 and 38.5 and i.movement_code in ('M1','M2','M3','M7') order by i.id limit 100")
def _(fx):
    i = fx["fx_inventory"].filter(F.col("x").between(10.05, 10.6) & F.col("y").between(38.0, 38.5) & F.col("movement_code").isin("M1", "M2", "M3", "M7"))
    top = i.orderBy("id").limit(100)
    names = fx["region"].select(F.col("r_regionkey").alias("label"), F.col("r_name").alias("name"))
    return R.lookup_join(top, names, "label").select("id", "movement_code", F.col("name").alias("label"))


@query("prj15_alert_selection", f"select cell_id, id from {LATEST} l where hard_escalation or ({RANK_CASE} >= 2 and ({RANK_CASE} >= 3 or s >= 0.5))")
def _(fx):
    return U.selected_for_alert(U.latest_state(fx["fx_rated"])).select("cell_id", "id")


@query("prj18_forecast_floor", f"select id from fx_rated where horizon like '+%' and {RANK_CASE} >= 2")
def _(fx):
    return fx["fx_rated"].filter(F.col("horizon").startswith("+") & B.at_least("level", "Moderate")).select("id")


@query("prj19_region_token", "select n_nationkey, regexp_replace(replace(lower(trim(concat('IT-', n_name, '-x'))), '-', '_'), '^(it|ita)_', '') as token from nation")
def _(fx):
    from slopewatch.functions.text import region_token

    return fx["nation"].select("n_nationkey", region_token(F.concat(F.lit("IT-"), F.col("n_name"), F.lit("-x"))).alias("token"))


@query("prj20_scalar_subquery", "with top as (select max(score) as m from fx_assess) select a.cell_id, max(a.score) as best, round(max(a.score) / (select m from top), 6) as share from fx_assess a group by a.cell_id")
def _(fx):
    a = fx["fx_assess"]
    return a.groupBy("cell_id").agg(F.max("score").alias("best")).select("cell_id", "best", r6(F.col("best") / a.agg(F.max("score").alias("m")).scalar(), "share"))


# --- equi joins ---------------------------------------------------------------------
@query("join1_assessment_cell", "select a.id, c.aoi_id from fx_assess a join fx_cells c on c.cell_id = a.cell_id")
def _(fx):
    return fx["fx_assess"].join(fx["fx_cells"], "cell_id").select("id", "aoi_id")


@query("join2_left_outer", "select c.cell_id, coalesce(a.id, -1) as id from fx_cells c left join (select * from fx_assess where score > 0.9) a on a.cell_id = c.cell_id")
def _(fx):
    return fx["fx_cells"].join(fx["fx_assess"].filter(F.col("score") > 0.9), "cell_id", "left").select("cell_id", F.coalesce("id", F.lit(-1)).alias("id"))


@query("join3_two_level_left", f"select m.istat_code, count(l.id) as n from fx_comuni m left join fx_cells c on c.istat_code = m.istat_code left join {LATEST} l on l.cell_id = c.cell_id and l.score > 0.5 group by m.istat_code")
def _(fx):
    hot = U.latest_state(fx["fx_rated"]).filter(F.col("score") > 0.5).select("cell_id", "id")
    per = fx["fx_cells"].join(hot, "cell_id").groupBy("istat_code").agg(F.count("id").alias("n"))
    return fx["fx_comuni"].select("istat_code").join(per, "istat_code", "left").select("istat_code", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("join4_code_decode", "select i.id, coalesce(r.r_name, 'n/d') as label from fx_inventory i left join region r on r.r_regionkey = i.label")
def _(fx):
    names = fx["region"].select(F.col("r_regionkey").alias("label"), "r_name")
    return R.lookup_join(fx["fx_inventory"], names, "label").select("id", F.coalesce("r_name", F.lit("n/d")).alias("label"))


@query("join22_latest_row_lookup", "select c.cell_id, coalesce(o.id, -1) as obs_id from fx_cells c left join (select * from (select *, row_number() over (partition by device_id order by phenomenon_time desc, id desc) as rn from fx_obs) t where rn = 1) o on o.device_id = c.cell_id")
def _(fx):
    last = R.latest_per_key(fx["fx_obs"], ["device_id"], ["phenomenon_time", "id"])
    return fx["fx_cells"].join(last, F.col("cell_id") == F.col("device_id"), "left").select("cell_id", F.coalesce("id", F.lit(-1)).alias("obs_id"))


@query("join23_semi", "select cell_id, exists(select 1 from fx_rated a where a.cell_id = c.cell_id and a.level = 'VeryHigh') as ever_very_high from fx_cells c")
def _(fx):
    seen = fx["fx_rated"].filter(F.col("level") == "VeryHigh").select("cell_id").distinct().withColumn("_s", F.lit(True))
    return fx["fx_cells"].join(seen, "cell_id", "left").select("cell_id", F.col("_s").isNotNull().alias("ever_very_high"))


@query("join24_anti", "select cell_id from fx_cells c where not exists (select 1 from fx_slides e where e.cell_id = c.cell_id)")
def _(fx):
    return fx["fx_cells"].join(fx["fx_slides"].select("cell_id"), "cell_id", "left_anti").select("cell_id")


@query("join25_area_values", "select c.cell_id, round(v.soil, 6) as soil from fx_cells c left join (select c2.aoi_id, avg(b.soil_moisture) as soil from fx_bundle b join fx_cells c2 on c2.cell_id = b.cell_id group by c2.aoi_id) v on v.aoi_id = c.aoi_id")
def _(fx):
    soil = fx["fx_bundle"].join(fx["fx_cells"].select("cell_id", "aoi_id"), "cell_id").groupBy("aoi_id").agg(F.avg("soil_moisture").alias("soil"))
    return R.lookup_join(fx["fx_cells"], soil, "aoi_id").select("cell_id", r6(F.col("soil"), "soil"))


@query("join28_last_run_rows", "select r.id, c.aoi_id, r.probability from fx_runs r join fx_cells c on c.cell_id = r.cell_id join (select c2.aoi_id, max(r2.computed_at) as ts from fx_runs r2 join fx_cells c2 on c2.cell_id = r2.cell_id group by c2.aoi_id) m on m.aoi_id = c.aoi_id and m.ts = r.computed_at")
def _(fx):
    runs = fx["fx_runs"].join(fx["fx_cells"].select("cell_id", "aoi_id"), "cell_id")
    last = runs.groupBy("aoi_id").agg(F.max("computed_at").alias("computed_at"))
    return R.lookup_join(runs, last, ["aoi_id", "computed_at"], "inner").select("id", "aoi_id", "probability")


@query("join30_hours_by_cell", "select c.aoi_id, count(*) as pairs from fx_cells c join (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-02', interval 1 hour)) as h) t on true group by c.aoi_id")
def _(fx):
    from slopewatch.operators.timeseries import hourly_axis

    bounds = fx["fx_cells"].withColumns({"start": F.lit("2024-01-01").cast("timestamp_ntz"), "stop": F.lit("2024-01-02").cast("timestamp_ntz")})
    return hourly_axis(bounds).groupBy("aoi_id").agg(F.count(F.lit(1)).alias("pairs"))


# --- aggregates -----------------------------------------------------------------------
@query("agg1_area_summary", f"select aoi_id, epoch_us(max(computed_at)) as computed_us, count(*) as cells, max(score) as max_score, count(*) filter (where {HIGH}) as high_or_above, count(*) filter (where level = 'Moderate') as moderate from {STATE} s group by aoi_id")
def _(fx):
    return U.risk_summary(state(fx)).withColumn("computed_us", B.epoch_us("computed_at")).drop("computed_at").orderBy(F.desc("high_or_above"), F.desc("max_score"))


@query("agg2_region_rollup", f"select a.aoi_id, a.name, count(s.cell_id) as n_cells, count(*) filter (where {HIGH}) as n_alert, max(s.score) as max_score, coalesce(arg_max(s.level, (s.score, -s.cell_id)), 'None') as worst_class from fx_aoi a left join {STATE} s on s.aoi_id = a.aoi_id group by a.aoi_id, a.name")
def _(fx):
    out = U.area_rollup(fx["fx_aoi"], state(fx), "aoi_id", ["aoi_id", "name"])
    return out.select("aoi_id", "name", "n_cells", "n_alert", "max_score", "worst_class")


MUNI = f"""select m.istat_code, m.name, m.aoi_id, count(s.cell_id) as n_cells, {COUNTS}, max(s.score) as max_score, coalesce(arg_max(s.level, (s.score, -s.cell_id)), 'None') as worst_class,
           round(coalesce(sum(s.e) filter (where {HIGH}), 0), 6) as alert_seismic, round(coalesce(sum(s.exposure) filter (where {HIGH}), 0), 6) as alert_exposure
    from fx_comuni m left join (select t.*, {EXPO} as exposure from {STATE} t left join fx_static st on st.cell_id = t.cell_id) s on s.istat_code = m.istat_code group by m.istat_code, m.name, m.aoi_id"""


def municipality_rollup(fx: Frames):
    exposed = U.with_exposure(R.lookup_join(state(fx), fx["fx_static"], "cell_id"))
    s = exposed.withColumns({"seismic": F.col("e"), "exposure": F.col("exposure.factor")})
    return U.area_rollup(fx["fx_comuni"], s, "istat_code", ["istat_code", "name", "aoi_id"])


@query("agg3_municipality_rollup", MUNI)
def _(fx):
    return municipality_rollup(fx).withColumns({c: F.round(c, 6) for c in ("alert_seismic", "alert_exposure")})


@query("agg4_rollup_levels", f"select coalesce(s.aoi_id, 'all') as aoi_id, coalesce(s.istat_code, -1) as istat_code, cast(grouping(s.aoi_id, s.istat_code) as bigint) as grouping, count(*) as n_cells, {COUNTS}, round(max(score), 6) as max_score from {STATE} s group by rollup(s.aoi_id, s.istat_code)")
def _(fx):
    return U.two_level_rollup(state(fx)).withColumns({"aoi_id": F.coalesce("aoi_id", F.lit("all")), "istat_code": F.coalesce("istat_code", F.lit(-1)), "max_score": F.round("max_score", 6)})


@query("agg5_count_by_level", f"select aoi_id, {COUNTS} from {STATE} s group by aoi_id")
def _(fx):
    return state(fx).groupBy("aoi_id").agg(*U.class_counts())


@query("agg6_national_totals", f"select count(distinct aoi_id) as regions, count(*) as cells, count(*) filter (where {HIGH}) as high_or_above, count(*) filter (where level = 'Moderate') as moderate, (select count(*) from fx_rated where {HIGH} and computed_at >= {AS_OF_SQL} - interval 720 hours) as recent_alerts from {STATE} s")
def _(fx):
    recent = fx["fx_rated"].filter(F.col("level").isin("High", "VeryHigh") & (F.col("computed_at") >= as_of() - F.make_dt_interval(hours=F.lit(720))))
    per = U.risk_summary(state(fx))
    return per.agg(
        F.count(F.lit(1)).alias("regions"), F.sum("cells").alias("cells"), F.sum("high_or_above").alias("high_or_above"), F.sum("moderate").alias("moderate")
    ).withColumn("recent_alerts", recent.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("agg7_municipality_detail", f"select istat_code, cell_id, round(score, 3) as score, level, n_cells from (select s.*, count(*) over () as n_cells from {STATE} s where istat_code = 7) t order by t.score desc, cell_id limit 500")
def _(fx):
    cells = state(fx).filter(F.col("istat_code") == 7)
    n = cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    return cells.orderBy(F.desc("score"), "cell_id").limit(500).select("istat_code", "cell_id", F.round("score", 3).alias("score"), "level", n.alias("n_cells"))


@query("agg33_distinct_versions", "select distinct pipeline_version from fx_assess")
def _(fx):
    return fx["fx_assess"].select("pipeline_version").distinct()


@query("agg39_latest_valuation", "select epoch_us(computed_at) as computed_us, pipeline_version from fx_assess order by computed_at desc, id desc limit 1")
def _(fx):
    return fx["fx_assess"].agg(F.max(F.struct("computed_at", "id", "pipeline_version")).alias("m")).select(B.epoch_us("m.computed_at").alias("computed_us"), "m.pipeline_version")


@query("agg44_target_shares", "select t.level, round(t.target, 6) as target, round(coalesce(g.achieved, 0), 6) as achieved, round(coalesce(g.achieved, 0) - t.target, 6) as gap from (values ('None', 0.7), ('Low', 0.2), ('Moderate', 0.07), ('High', 0.025), ('VeryHigh', 0.005)) t(level, target) left join (select level, count(*)::double / (select count(*) from fx_rated) as achieved from fx_rated group by level) g on g.level = t.level")
def _(fx):
    out = U.frequency_against_target(fx["fx_rated"])
    return out.select("level", r6(F.col("target"), "target"), r6(F.col("achieved"), "achieved"), r6(F.col("gap"), "gap"))


@query("agg45_forecast_summary", f"""with s as (select * from {LATEST} l where horizon like '+%'), r as (select cell_id, max(probability) as probability from fx_runs group by cell_id)
    select 'level' as part, level as key, count(*)::double as value from s group by level union all
    (select 'score', cast(cell_id as varchar), round(score, 6) from s order by score desc, cell_id limit 10) union all
    (select 'probability', cast(cell_id as varchar), round(probability, 6) from r order by probability desc, cell_id limit 10)""")
def _(fx):
    s = U.latest_state(fx["fx_rated"]).filter(F.col("horizon").startswith("+"))
    runs = fx["fx_runs"].groupBy("cell_id").agg(F.max("probability").alias("probability"))
    levels = s.groupBy("level").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("level").alias("part"), F.col("level").alias("key"), "value")
    best = s.orderBy(F.desc("score"), "cell_id").limit(10).select(F.lit("score").alias("part"), F.col("cell_id").cast("string").alias("key"), r6(F.col("score"), "value"))
    ml = runs.orderBy(F.desc("probability"), "cell_id").limit(10).select(F.lit("probability").alias("part"), F.col("cell_id").cast("string").alias("key"), r6(F.col("probability"), "value"))
    return levels.unionByName(best).unionByName(ml)


# --- rankings -----------------------------------------------------------------------------
@query("top1_cells", f"select cell_id, aoi_id, round(score, 3) as score, level from {STATE} s order by s.score desc, cell_id limit 100")
def _(fx):
    return U.top_cells(state(fx), 400).select("cell_id", "aoi_id", F.round("score", 3).alias("score"), "level")


@query("top2_recent_alerts", f"select a.id, c.aoi_id, a.level from fx_rated a join fx_cells c on c.cell_id = a.cell_id where {RANK_CASE.replace('level', 'a.level')} >= 2 and a.computed_at >= {AS_OF_SQL} - interval 4320 hours order by a.computed_at desc, a.score desc, a.id limit 50")
def _(fx):
    recent = fx["fx_rated"].filter(B.at_least("level", "Moderate") & (F.col("computed_at") >= as_of() - F.make_dt_interval(hours=F.lit(4320))))
    # every assessment has its cell, so the limit comes before the join
    top = recent.join(fx["fx_cells"].select("cell_id", "aoi_id"), "cell_id").orderBy(F.desc("computed_at"), F.desc("score"), "id").limit(50)
    return top.select("id", "aoi_id", "level")


ALERTS = f"""select l.cell_id, c.aoi_id, c.lon, c.lat, l.level, l.score, {EXPO} as factor, l.score * (1 + {EXPO}) as priority
    from (select * from (select *, row_number() over (partition by cell_id order by computed_at desc, id desc) as rn from fx_rated where {RANK_CASE} >= 2 and computed_at >= {AS_OF_SQL} - interval 26280 hours) t where rn = 1) l
    join fx_cells c on c.cell_id = l.cell_id left join fx_static st on st.cell_id = l.cell_id"""


@query("top3_alert_list", f"select cell_id, aoi_id, lon, lat, level, score, round(factor, 6) as exposure, round(priority, 6) as priority from ({ALERTS}) a order by a.priority desc, cell_id limit 200")
def _(fx):
    cells = fx["fx_cells"].select("cell_id", "aoi_id", "lon", "lat")
    out = U.alert_list(fx["fx_rated"], cells, fx["fx_static"], as_of(), since_hours=26280, limit=200)
    return out.select("cell_id", "aoi_id", "lon", "lat", "level", "score", r6(F.col("exposure.factor"), "exposure"), r6(F.col("priority"), "priority"))


@query("top3_alert_priorities", f"select cell_id, round(priority, 6) as priority from ({ALERTS}) a")
def _(fx):
    out = U.alert_list(fx["fx_rated"], fx["fx_cells"].select("cell_id", "aoi_id"), fx["fx_static"], as_of(), since_hours=26280)
    return out.select("cell_id", r6(F.col("priority"), "priority"))


@query("top4_municipalities", f"select istat_code, name, n_alert, alert_exposure, max_score from ({MUNI}) t where n_alert > 0 order by alert_exposure desc, n_alert desc, max_score desc, istat_code limit 15")
def _(fx):
    out = municipality_rollup(fx).withColumn("alert_exposure", F.round("alert_exposure", 6)).filter(F.col("n_alert") > 0)
    return out.orderBy(F.desc("alert_exposure"), F.desc("n_alert"), F.desc("max_score"), "istat_code").limit(15).select("istat_code", "name", "n_alert", "alert_exposure", "max_score")


@query("top5_work_order", "select m.istat_code, row_number() over (order by l.last_us nulls first, m.istat_code) as position from fx_comuni m left join (select c.istat_code, max(epoch_us(a.computed_at)) as last_us from fx_assess a join fx_cells c on c.cell_id = a.cell_id where a.score > 0.98 group by c.istat_code) l on l.istat_code = m.istat_code")
def _(fx):
    last = fx["fx_assess"].filter(F.col("score") > 0.98).join(fx["fx_cells"].select("cell_id", "istat_code"), "cell_id").groupBy("istat_code").agg(F.max("computed_at").alias("last"))
    # one row per area: the numbering runs over the small dimension only
    w = Window.orderBy(F.asc_nulls_first("last"), "istat_code")
    return fx["fx_comuni"].join(last, "istat_code", "left").select("istat_code", F.row_number().over(w).cast("bigint").alias("position"))


DOMINANT = "case greatest(s, m, e, f, h, k) when s then 'S' when m then 'M' when e then 'E' when f then 'F' when h then 'H' else 'K' end"


@query("top6_escalation_evidence", f"select cell_id, level, score, hard_escalation, {DOMINANT} as dominant from {LATEST} l where {RANK_CASE} >= 3 or hard_escalation order by score desc, cell_id limit 50")
def _(fx):
    return U.escalation_evidence(U.latest_state(fx["fx_rated"]), 50).select("cell_id", "level", "score", "hard_escalation", "dominant")


@query("fn22_tie_stable_argmax", f"select id, {DOMINANT} as dominant from fx_assess")
def _(fx):
    return fx["fx_assess"].select("id", B.argmax_name({c: F.col(c.lower()) for c in "SMEFHK"}).alias("dominant"))


@query("top7_shown_level", f"select least(3, max({RANK_CASE})) as shown_rank from {LATEST} l where {RANK_CASE} >= 1")
def _(fx):
    return U.shown_level(U.latest_state(fx["fx_rated"]))


@query("top8_salience", f"""with s as (select * from {STATE} t where {RANK_CASE} >= 1), c as (select aoi_id, count(*) as total, quantile_cont(score, 0.5) + 0.08 as cut from s group by aoi_id)
    select c.aoi_id, c.total, count(*) filter (where c.total <= 200 or s.score >= c.cut) as kept, c.total - count(*) filter (where c.total <= 200 or s.score >= c.cut) as diffuse from s join c on c.aoi_id = s.aoi_id group by c.aoi_id, c.total""")
def _(fx):
    _, diffuse = U.salient(state(fx).filter(B.rank_of("level") >= 1))
    return diffuse.select("aoi_id", "total", "kept", "diffuse")


@query("agg34_salience_cut", f"select aoi_id, round(quantile_cont(score, 0.5) + 0.08, 6) as cut from {STATE} s group by aoi_id")
def _(fx):
    from slopewatch.operators.running import exact_percentiles

    return exact_percentiles(state(fx), "score", {"p": 0.5}, ["aoi_id"]).select("aoi_id", r6(F.col("p") + 0.08, "cut"))


@query("top10_forecast_list", f"select id, horizon, level from fx_rated where horizon like '+%' and computed_at >= {AS_OF_SQL} - interval 8760 hours order by computed_at desc, id limit 50")
def _(fx):
    rows = fx["fx_rated"].filter(F.col("horizon").startswith("+") & (F.col("computed_at") >= as_of() - F.make_dt_interval(hours=F.lit(8760))))
    return rows.orderBy(F.desc("computed_at"), "id").limit(50).select("id", "horizon", "level")


@query("top11_top_probabilities", "select r.id, c.aoi_id, round(r.probability, 3) as probability from fx_runs r join fx_cells c on c.cell_id = r.cell_id join (select c2.aoi_id, max(r2.computed_at) as ts from fx_runs r2 join fx_cells c2 on c2.cell_id = r2.cell_id group by c2.aoi_id) m on m.aoi_id = c.aoi_id and m.ts = r.computed_at order by r.probability desc, r.id limit 10")
def _(fx):
    runs = fx["fx_runs"].join(fx["fx_cells"].select("cell_id", "aoi_id"), "cell_id")
    last = runs.groupBy("aoi_id").agg(F.max("computed_at").alias("computed_at"))
    top = R.lookup_join(runs, last, ["aoi_id", "computed_at"], "inner").orderBy(F.desc("probability"), "id").limit(10)
    return top.select("id", "aoi_id", F.round("probability", 3).alias("probability"))


@query("top12_severity_ladder", "select hazard_class, authority from fx_hazard order by case hazard_class when 'P4' then 5 when 'P3' then 4 when 'P2' then 3 when 'P1' then 2 when 'AA' then 1 else 0 end desc, geom_id limit 1")
def _(fx):
    rank = B.lookup({"AA": 1, "P1": 2, "P2": 3, "P3": 4, "P4": 5}, "hazard_class")
    return fx["fx_hazard"].orderBy(F.coalesce(rank, F.lit(0)).desc(), "geom_id").limit(1).select("hazard_class", "authority")


# --- set operations -----------------------------------------------------------------------------
@query("set1_union_layers", "select 'road' as family, id from fx_network where kind = 'road' union all select 'rail', id from fx_network where kind = 'rail' union all select 'inventory', id from fx_inventory")
def _(fx):
    n = fx["fx_network"]
    layers = [n.filter(F.col("kind") == k).select(F.lit(k).alias("family"), "id") for k in ("road", "rail")]
    return layers[0].unionByName(layers[1]).unionByName(fx["fx_inventory"].select(F.lit("inventory").alias("family"), "id"))


@query("set2_union_samples", "select cell_id, 1 as label from fx_slides union all select cell_id, 0 from fx_cells where cell_id not in (select cell_id from fx_slides)")
def _(fx):
    pos = fx["fx_slides"].select("cell_id", F.lit(1).alias("label"))
    return pos.unionByName(fx["fx_cells"].join(pos, "cell_id", "left_anti").select("cell_id", F.lit(0).alias("label")))


@query("set3_union_trend", "select id, 'observed' as kind from fx_assess where horizon not like '+%' union all select id, 'forecast' from fx_assess where horizon like '+%'")
def _(fx):
    # one scan with a derived tag says the same as a union of two filtered scans
    return fx["fx_assess"].select("id", F.when(F.col("horizon").startswith("+"), "forecast").otherwise("observed").alias("kind"))


@query("set4_missed_events", "select event_id from fx_slides except select e.event_id from fx_slides e join fx_rated a on a.cell_id = e.cell_id where a.level = 'VeryHigh'")
def _(fx):
    warned = fx["fx_rated"].filter(F.col("level") == "VeryHigh").select("cell_id")
    return fx["fx_slides"].join(warned, "cell_id", "left_anti").select("event_id")


@query("set5_minus_suppressed", f"select cell_id from {LATEST} l where {HIGH} except select cell_id from fx_slides")
def _(fx):
    hot = U.latest_state(fx["fx_rated"]).filter(F.col("level").isin("High", "VeryHigh"))
    return hot.join(fx["fx_slides"].select("cell_id"), "cell_id", "left_anti").select("cell_id")


@query("set6_distinct_pairs", "select distinct cell_id, epoch_us(date_trunc('day', event_time)) as day_us from fx_slides")
def _(fx):
    return fx["fx_slides"].select("cell_id", B.epoch_us(B.floor_to("event_time", "day")).alias("day_us")).dropDuplicates(["cell_id", "day_us"])
