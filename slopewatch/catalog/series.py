"""Queries over rain series, sensor streams and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.catalog.registry import Frames, query
from slopewatch.catalog.rollups import AS_OF_SQL, as_of, r6
from slopewatch.functions import basic as B
from slopewatch.operators import sensors as N
from slopewatch.operators import timeseries as T
from slopewatch.operators.asof import asof_join
from slopewatch.operators.learning import guarded_corr
from slopewatch.operators.relational import latest_per_key, top_per_key
from slopewatch.operators.running import exact_percentiles
from slopewatch.session import cut_lineage

EVENTS = """
    a as (select *, row_number() over (partition by series_id order by ts) as rn from fx_rain),
    w as (select *, case when rn - lag(rn) over (partition by series_id order by rn) - 1 >= 6 then 1 else 0 end as ns from a where mm > 0),
    i as (select *, sum(ns) over (partition by series_id order by rn) as ev from w),
    g as (select series_id, ev, min(ts) as t0, max(ts) as t1, max(rn) as er, sum(mm) as total,
                 greatest(1.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 + 1) as dur
          from i group by series_id, ev having sum(mm) >= 2.0)"""


@query("ts1_rain_events", f"with {EVENTS} select series_id, er as end_seq, epoch_us(t0) as start_us, round(total, 4) as total_mm, round(dur, 4) as duration_h from g")
def _(fx):
    e = T.rain_events(fx["fx_rain"])
    return e.select("series_id", "end_seq", B.epoch_us("start").alias("start_us"), F.round("total_mm", 4).alias("total_mm"), F.round("duration_h", 4).alias("duration_h"))


@query("ts2_latest_event", f"with {EVENTS} select series_id, er as end_seq, round(total, 4) as total_mm, n from (select *, row_number() over (partition by series_id order by er desc) as k, count(*) over (partition by series_id) as n from g) q where k = 1")
def _(fx):
    e = T.rain_events(fx["fx_rain"])
    n = e.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return T.latest_event(e).join(n, "series_id").select("series_id", "end_seq", F.round("total_mm", 4).alias("total_mm"), "n")


@query("ts3_trailing_window", "select r.series_id, count(*) as n, round(sum(mm), 4) as mm from fx_rain r join (select series_id, max(ts) as last_ts from fx_rain group by series_id) m on m.series_id = r.series_id where r.ts >= m.last_ts - interval 240 hours group by r.series_id")
def _(fx):
    w = T.trailing_window(fx["fx_rain"], 240)
    return w.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mm"), 4).alias("mm"))


@query("ts4_antecedent_index", """with d as (select series_id, date_trunc('day', ts) as day, sum(mm) as mm from fx_rain group by all),
    q as (select *, row_number() over (partition by series_id order by day desc) - 1 as age from d)
    select series_id, round(sum(mm * pow(0.95, age)), 4) as api_mm from q group by series_id""")
def _(fx):
    daily = fx["fx_rain"].groupBy("series_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum("mm").alias("mm"))
    return T.antecedent_index(daily).select("series_id", F.round("api_mm", 4).alias("api_mm"))


QC = """q as (select *, lag(result_value) over w as pv, lag(phenomenon_time) over w as pt,
        count(*) over l as n11, min(result_value) over l as lo, max(result_value) over l as hi,
        case observed_property when 'rainfall' then 0.5 when 'pore_pressure' then 5.0 when 'soil_moisture' then 0.02 when 'displacement' then 1.0 else 3.0 end as sg,
        case observed_property when 'rainfall' then result_value between 0 and 200 when 'pore_pressure' then result_value between 0 and 1000
             when 'soil_moisture' then result_value between 0 and 1 when 'displacement' then result_value between -50000 and 50000 else result_value between -2000 and 2000 end as in_range
      from fx_obs window w as (partition by device_id, observed_property order by phenomenon_time, id),
        l as (partition by device_id, observed_property order by phenomenon_time, id rows between 11 preceding and 1 preceding)),
    c as (select *, coalesce(abs(result_value - pv) > 5 * sg, false) as spike, coalesce(n11 = 11 and lo = result_value and hi = result_value, false) as flatline,
                 coalesce(phenomenon_time - pt > interval 60 minutes, false) as gap from q),
    f as (select *, case when not in_range then 'range' when spike then 'spike' when flatline then 'flatline' when gap then 'gap' else 'ok' end as quality from c)"""


@query("ts5_ts6_ts7_quality", f"with {QC} select id, spike, flatline, gap, quality from f")
def _(fx):
    return N.quality(fx["fx_obs"]).select("id", "spike", "flatline", "gap", "quality")


# one coarse value per reading, so that equal neighbours occur
COARSE = "(select id, device_id % 3 as device_id, observed_property, phenomenon_time, floor(result_value / 400) as result_value from fx_obs)"


@query("ts6_flatline_coarse", f"""select device_id, observed_property, count(*) filter (where n11 = 11 and lo = v and hi = v) as flat from (
    select *, result_value as v, count(*) over l as n11, min(result_value) over l as lo, max(result_value) over l as hi from {COARSE} z
    window l as (partition by device_id, observed_property order by phenomenon_time, id rows between 11 preceding and 1 preceding)) t group by all""")
def _(fx):
    coarse = fx["fx_obs"].select("id", (F.col("device_id") % 3).alias("device_id"), "observed_property", "phenomenon_time", F.floor(F.col("result_value") / 400).cast("double").alias("result_value"))
    # small blocks here exercise the carry between blocks of one long stream
    return N.quality(coarse, block_rows=500).groupBy("device_id", "observed_property").agg(F.count_if("flatline").alias("flat"))


@query("ts9_hourly_axis", "select device_id, count(*) as hours from (select device_id, unnest(generate_series(date_trunc('hour', min(phenomenon_time)), date_trunc('hour', max(phenomenon_time)), interval 1 hour)) as h from fx_obs group by device_id) t group by device_id")
def _(fx):
    span = fx["fx_obs"].groupBy("device_id").agg(F.date_trunc("hour", F.min("phenomenon_time")).alias("start"), F.date_trunc("hour", F.max("phenomenon_time")).alias("stop"))
    return T.hourly_axis(span).groupBy("device_id").agg(F.count(F.lit(1)).alias("hours"))


@query("ts10_series_from_totals", """select id, count(*) as n, round(sum(mm), 4) as mm, min(us) as first_us from (
      select b.id, epoch_us(valuation_time) - (i + 1) * 3600000000 as us, case when i < 24 then rain_24h_mm / 24 else greatest(0, coalesce(flood_rain_72h_mm, 0) - rain_24h_mm) / 48 end as mm
      from fx_bundle b, range(72) r(i)) t where mm > 0 group by id""")
def _(fx):
    s = T.series_from_aggregates(fx["fx_bundle"], "valuation_time", "rain_24h_mm", "flood_rain_72h_mm")
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mm"), 4).alias("mm"), B.epoch_us(F.min("ts")).alias("first_us"))


ANTECEDENT = """select q.id, {outer} from fx_obs q left join fx_rain r on r.series_id = q.device_id and r.ts <= q.phenomenon_time and r.ts >= q.phenomenon_time - interval 720 hours
    where q.observed_property = 'displacement' group by q.id, q.phenomenon_time"""


@query("agg14_antecedent_rain", ANTECEDENT.format(outer="""round(coalesce(sum(mm) filter (where r.ts >= q.phenomenon_time - interval 24 hours), 0), 2) as rain_24h_mm,
    round(coalesce(sum(mm) filter (where r.ts >= q.phenomenon_time - interval 72 hours), 0), 2) as rain_72h_mm, round(coalesce(sum(mm), 0), 2) as rain_30d_mm,
    round(coalesce(max(mm) filter (where r.ts >= q.phenomenon_time - interval 24 hours), 0), 2) as max_i_24h_mmh, count(r.ts) = 0 as degraded"""))
def _(fx):
    points = fx["fx_obs"].filter(F.col("observed_property") == "displacement").select("id", "device_id", "phenomenon_time")
    samples = fx["fx_rain"].withColumnRenamed("series_id", "device_id")
    out = T.antecedent_rain(points, samples, key="device_id", at="phenomenon_time")
    return out.drop("device_id", "phenomenon_time")


@query("win5_rain_24h", "select q.series_id, epoch_us(q.ts) as us, round((select sum(r.mm) from fx_rain r where r.series_id = q.series_id and r.ts between q.ts - interval 24 hours and q.ts), 2) as rain_24h_mm from fx_rain q")
def _(fx):
    pts = fx["fx_rain"].select("series_id", F.col("ts").alias("as_of"))
    out = T.antecedent_rain(pts, fx["fx_rain"], key="series_id")
    return out.select("series_id", B.epoch_us("as_of").alias("us"), "rain_24h_mm")


@query("win4_sliding_48h", """with h as (select series_id, unnest(generate_series(timestamp '2024-01-03', timestamp '2024-01-30', interval 6 hours)) as t from (select distinct series_id from fx_rain) s)
    select h.series_id, epoch_us(h.t) as us, count(r.ts) as n, round(coalesce(sum(r.mm), 0), 4) as mm from h left join fx_rain r on r.series_id = h.series_id and r.ts between h.t - interval 48 hours and h.t group by h.series_id, h.t""")
def _(fx):
    # every sample feeds the evaluation times of the next 48 h: at most nine on a 6 h axis
    step, first, last = 6 * 3600, 1704240000, 1706572800
    s = fx["fx_rain"].withColumn("_s", F.floor(B.epoch_us("ts") / 1_000_000))
    k0 = F.greatest(F.ceil((F.col("_s") - first) / step), F.lit(0))
    k1 = F.least(F.floor((F.col("_s") + 48 * 3600 - first) / step), F.lit((last - first) // step))
    hit = s.filter(k0 <= k1).withColumn("k", F.explode(F.sequence(k0, k1))).groupBy("series_id", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("mm").alias("mm"))
    axis = fx["fx_rain"].select("series_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((last - first) // step).cast("bigint"))))
    return axis.join(hit, ["series_id", "k"], "left").select(
        "series_id", ((F.col("k") * step + first) * 1_000_000).alias("us"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.round(F.coalesce("mm", F.lit(0.0)), 4).alias("mm")
    )


# --- sensors -----------------------------------------------------------------------
def labelled(fx: Frames):
    return N.quality(fx["fx_obs"])


FEATURES = """select {key}, date_trunc('{unit}', phenomenon_time) as bucket, sum(result_value) filter (where observed_property = 'rainfall') as rainfall_mm,
      avg(result_value) filter (where observed_property = 'pore_pressure') as pore_pressure_kpa, avg(result_value) filter (where observed_property = 'soil_moisture') as soil_moisture,
      arg_max(result_value, (phenomenon_time, id)) filter (where observed_property = 'displacement') as displacement_mm,
      case when count(*) filter (where observed_property = 'displacement') > 1 then
        regr_slope(result_value, (epoch_us(phenomenon_time) - epoch_us(date_trunc('{unit}', phenomenon_time))) / 8.64e10) filter (where observed_property = 'displacement') end as velocity_mmd,
      count(*) as sample_count, max(epoch_us(phenomenon_time)) as last_us
    from {source} where observed_property <> 'velocity' {ok} group by {key}, date_trunc('{unit}', phenomenon_time)"""


@query("agg15_hourly_features", f"with {QC}, h as ({FEATURES.format(key='device_id', unit='hour', source='f', ok=chr(97) + chr(110) + chr(100) + ' quality = ' + chr(39) + 'ok' + chr(39))}) select device_id, epoch_us(bucket) as bucket_us, round(rainfall_mm, 4) as rainfall_mm, round(pore_pressure_kpa, 4) as pore_pressure_kpa, round(soil_moisture, 4) as soil_moisture, displacement_mm, sample_count, last_us from h")
def _(fx):
    h = N.hourly_features(labelled(fx), F.date_trunc("hour", "phenomenon_time"))
    return h.select(
        "device_id", B.epoch_us("bucket").alias("bucket_us"), *[F.round(c, 4).alias(c) for c in ("rainfall_mm", "pore_pressure_kpa", "soil_moisture")],
        "displacement_mm", "sample_count", B.epoch_us("last_observation_at").alias("last_us"),
    )


DAILY = FEATURES.format(key="site_id, device_id", unit="day", source="fx_obs", ok="")


def daily_features(fx: Frames):
    obs = fx["fx_obs"].withColumn("quality", F.lit("ok"))
    return N.hourly_features(obs, F.date_trunc("day", "phenomenon_time"), ("site_id", "device_id"))


@query("agg16_velocity", f"select device_id, epoch_us(bucket) as bucket_us, round(velocity_mmd, 2) as velocity_mmd from ({DAILY}) d")
def _(fx):
    return daily_features(fx).select("device_id", B.epoch_us("bucket").alias("bucket_us"), F.round("velocity_mmd", 2).alias("velocity_mmd"))


@query("agg17_last_displacement", f"select device_id, epoch_us(bucket) as bucket_us, displacement_mm from ({DAILY}) d where displacement_mm is not null")
def _(fx):
    return daily_features(fx).filter(F.col("displacement_mm").isNotNull()).select("device_id", B.epoch_us("bucket").alias("bucket_us"), "displacement_mm")


def first_by_device(col: str) -> str:
    return f"arg_min({col}, device_id) filter (where {col} is not null) as {col}"


MERGED = f"select site_id, bucket, {', '.join(first_by_device(c) for c in N.FEATURES)}, cast(sum(sample_count) as bigint) as sample_count, max(last_us) as last_us from ({DAILY}) d group by site_id, bucket"


def merged_features(fx: Frames):
    return N.merge_devices(daily_features(fx), "site_id")


@query("agg18_merge_devices", f"select site_id, epoch_us(bucket) as bucket_us, round(rainfall_mm, 4) as rainfall_mm, round(pore_pressure_kpa, 4) as pore_pressure_kpa, displacement_mm, round(velocity_mmd, 2) as velocity_mmd, sample_count, last_us from ({MERGED}) m")
def _(fx):
    m = merged_features(fx)
    return m.select(
        "site_id", B.epoch_us("bucket").alias("bucket_us"), F.round("rainfall_mm", 4).alias("rainfall_mm"), F.round("pore_pressure_kpa", 4).alias("pore_pressure_kpa"),
        "displacement_mm", F.round("velocity_mmd", 2).alias("velocity_mmd"), "sample_count", B.epoch_us("last_observation_at").alias("last_us"),
    )


@query("join21_ts8_motion", f"""with m as ({MERGED}), p as (select *, last_value(velocity_mmd ignore nulls) over (partition by site_id order by bucket rows between unbounded preceding and 1 preceding) as pv from m)
    select site_id, epoch_us(bucket) as bucket_us, round(pv, 2) as prev_velocity, round((velocity_mmd - pv) * 24, 2) as acceleration_mmd2, round(case when velocity_mmd > 1e-6 then 1 / velocity_mmd end, 6) as inverse_velocity from p""")
def _(fx):
    m = N.with_motion(merged_features(fx), "site_id")
    return m.select("site_id", B.epoch_us("bucket").alias("bucket_us"), F.round("prev_velocity", 2).alias("prev_velocity"), F.round("acceleration_mmd2", 2).alias("acceleration_mmd2"), r6(F.col("inverse_velocity"), "inverse_velocity"))


@query("agg43_snow_and_soil", "select cell_id, max(snow_depth_m) as snow_depth_m, round(avg(soil_moisture), 6) as soil_moisture from fx_bundle group by cell_id")
def _(fx):
    return fx["fx_bundle"].groupBy("cell_id").agg(F.max("snow_depth_m").alias("snow_depth_m"), r6(F.avg("soil_moisture"), "soil_moisture"))


# --- as-of joins ----------------------------------------------------------------------
PAIRS = """(select * from (select m.id, m.cell_id, m.probability, a.id as assess_id, a.score, a.level, row_number() over (partition by m.id order by abs(epoch_us(a.computed_at) - epoch_us(m.computed_at)), a.computed_at, a.id) as rn
    from fx_runs m join fx_rated a on a.cell_id = m.cell_id and a.computed_at between m.computed_at - interval 720 hours and m.computed_at + interval 720 hours) t where rn = 1)"""
ML_LEVEL = "case when probability < 0.15 then 'None' when probability < 0.35 then 'Low' when probability < 0.55 then 'Moderate' when probability < 0.75 then 'High' else 'VeryHigh' end"


def pairs(fx: Frames):
    """Challenger runs with the champion assessment nearest in time."""
    out = asof_join(
        fx["fx_runs"], fx["fx_rated"], ["cell_id"], "computed_at", "computed_at", ["id", "score", "level"],
        direction="nearest", tolerance_hours=720, tie="id", bucket_hours=24 * 90, inner=True,
    )
    return out.select("id", "cell_id", "probability", F.col("match.id").alias("assess_id"), F.col("match.score").alias("score"), F.col("match.level").alias("level"))


@query("join19_nearest_in_time", f"select id, assess_id from {PAIRS} p")
def _(fx):
    return pairs(fx).select("id", "assess_id")


DIV = f"(select p.*, c.aoi_id, abs(probability - score) as d, {ML_LEVEL} as ml_level from {PAIRS} p join fx_cells c on c.cell_id = p.cell_id)"


def divergence(fx: Frames):
    p = pairs(fx).join(fx["fx_cells"].select("cell_id", "aoi_id"), "cell_id")
    return p.withColumns({"d": F.abs(F.col("probability") - F.col("score")), "ml_level": B.level_of("probability")})


@query("agg8_divergence", f"select aoi_id, count(*) as n, round(avg(d), 6) as mean_abs, round(quantile_cont(d, 0.95), 6) as p95_abs, round(max(d), 6) as max_abs, round(corr(score, probability), 6) as correlation, round(avg(case when ml_level = level then 1.0 else 0.0 end), 6) as agreement from {DIV} v group by aoi_id")
def _(fx):
    also = [
        F.count(F.lit(1)).alias("n"), r6(F.avg("d"), "mean_abs"), r6(F.max("d"), "max_abs"), r6(guarded_corr("score", "probability", 2), "correlation"),
        r6(F.avg((F.col("ml_level") == F.col("level")).cast("double")), "agreement"),
    ]
    pairs_once = cut_lineage(divergence(fx).select("aoi_id", "d", "score", "probability", "level", "ml_level"))  # read by every pass below
    return exact_percentiles(pairs_once, "d", {"p95_abs": 0.95}, ["aoi_id"], also=also).withColumn("p95_abs", F.round("p95_abs", 6))


@query("agg10_guarded_pearson", f"select cell_id, case when count(*) >= 3 and var_pop(score) > 0 and var_pop(probability) > 0 then round(corr(score, probability), 6) end as r from {PAIRS} p group by cell_id")
def _(fx):
    return pairs(fx).groupBy("cell_id").agg(F.round(guarded_corr("score", "probability", 3), 6).alias("r"))


@query("win2_top_divergent", f"select aoi_id, id, round(d, 6) as d, rn from (select *, row_number() over (partition by aoi_id order by round(d, 6) desc, cell_id, id) as rn from (select * exclude (rn) from {DIV} v) z) t where rn <= 10")
def _(fx):
    v = divergence(fx).withColumn("d", F.round("d", 6))
    return top_per_key(v, ["aoi_id"], [F.desc("d"), F.asc("cell_id"), F.asc("id")], 10, "rn").select("aoi_id", "id", "d", F.col("rn").cast("bigint").alias("rn"))


TRUTH = """select e.event_id, e.cell_id,
    (select a.score from fx_assess a where a.cell_id = e.cell_id and a.computed_at between e.event_time - interval 1440 hours and e.event_time order by a.computed_at desc, a.id limit 1) as champion,
    (select r.probability from fx_runs r where r.cell_id = e.cell_id and r.computed_at between e.event_time - interval 1440 hours and e.event_time order by r.computed_at desc, r.id limit 1) as challenger
    from fx_truth e"""


def truth_table(fx: Frames):
    """Events with the last value of both engines inside the look-back."""
    look = {"tolerance_hours": 1440, "tie": "id", "bucket_hours": 24 * 90}
    one = asof_join(fx["fx_truth"], fx["fx_assess"], ["cell_id"], "event_time", "computed_at", ["id", "score"], into={"score": "champion"}, **look)
    return asof_join(one, fx["fx_runs"], ["cell_id"], "event_time", "computed_at", ["id", "probability"], into={"probability": "challenger"}, **look)


@query("join20_last_before_event", f"select event_id, round(champion, 6) as champion, round(challenger, 6) as challenger from ({TRUTH}) t")
def _(fx):
    return truth_table(fx).select("event_id", r6(F.col("champion"), "champion"), r6(F.col("challenger"), "challenger"))


@query("agg42_first_event_per_cell", "select cell_id, epoch_us(min(event_time)) as first_us from fx_truth group by cell_id")
def _(fx):
    return fx["fx_truth"].groupBy("cell_id").agg(B.epoch_us(F.min("event_time")).alias("first_us"))


@query("join15_nearest_node", """with b as (select min(lon) as x0, min(lat) as y0, floor((max(lon) - min(lon) + 1e-9) / 0.1) as nx, floor((max(lat) - min(lat) + 1e-9) / 0.1) as ny from fx_cells),
    n as (select i, j, x0 + 0.1 * i as x, y0 + 0.1 * j as y from b, (select unnest(range(0, cast(nx as bigint) + 1)) as i from b) p, (select unnest(range(0, cast(ny as bigint) + 1)) as j from b) q)
    select cell_id, node from (select c.cell_id, n.i * 1000 + n.j as node, row_number() over (partition by c.cell_id order by round(pow(c.lon - n.x, 2) + pow(c.lat - n.y, 2), 9), n.j, n.i) as rn from fx_cells c, n) t where rn = 1""")
def _(fx):
    from slopewatch.sources.weather import nearest_lattice_node

    cells = fx["fx_cells"]
    box = tuple(cells.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first())
    i, j = nearest_lattice_node(F.col("lon"), F.col("lat"), box, 0.1)
    return cells.select("cell_id", (i * 1000 + j).alias("node"))


# --- dates and small functions -----------------------------------------------------------
@query("fn11_floor_dates", "select event_id, epoch_us(date_trunc('hour', ts)) as h, epoch_us(date_trunc('day', ts)::timestamp) as d, epoch_us(date_trunc('month', ts)::timestamp) as m from events")
def _(fx):
    return fx["events"].select("event_id", *[B.epoch_us(B.floor_to("ts", u)).alias(u[0]) for u in ("hour", "day", "month")])


@query("fn12_ages_and_build_id", f"select o_orderkey, round((epoch_us({AS_OF_SQL}) - epoch_us(o_orderdate)) / 3.6e9, 4) as age_h, strftime(o_orderdate, '%Y-%m-%dT%H%MZ') as build from orders")
def _(fx):
    return fx["orders"].select("o_orderkey", F.round(B.hours_between(as_of(), "o_orderdate"), 4).alias("age_h"), B.build_id("o_orderdate").alias("build"))


@query("fn13_pseudo_time", "select c_custkey, ('0x' || substr(sha256(cast(c_custkey as varchar)), 1, 8))::bigint % 3650 as days from customer")
def _(fx):
    return fx["customer"].select("c_custkey", B.pseudo_offset_days("c_custkey").alias("days"))


@query("fn14_clamp_date", "select o_orderkey, cast(least(cast(o_orderdate as date), date '1998-06-01') as varchar) as day from orders")
def _(fx):
    return fx["orders"].select("o_orderkey", B.clamp_date(F.col("o_orderdate").cast("date"), F.lit("1998-06-01").cast("date")).cast("string").alias("day"))


@query("fn31_interval_arithmetic", "select event_id, epoch_us(ts + interval 90 minutes) as us, epoch_us(ts - interval 2 days) as back_us from events")
def _(fx):
    return fx["events"].select(
        "event_id", B.epoch_us(F.col("ts") + F.make_dt_interval(mins=F.lit(90))).alias("us"), B.epoch_us(F.col("ts") - F.make_dt_interval(days=F.lit(2))).alias("back_us")
    )


@query("fn23_calibration", "select id, round(result_value * case observed_property when 'rainfall' then 2.0 when 'displacement' then 0.5 else 1.0 end + case observed_property when 'rainfall' then 1.0 else 0.0 end, 6) as value from fx_obs")
def _(fx):
    entry = lambda a, b: F.struct(F.lit(a).alias("scale"), F.lit(b).alias("offset"))
    table = F.create_map(F.lit("rainfall"), entry(2.0, 1.0), F.lit("displacement"), entry(0.5, None).cast("struct<scale:double,offset:double>"))
    return fx["fx_obs"].select("id", r6(B.calibrated(F.col("result_value"), table, F.col("observed_property")), "value"))


@query("fn24_lookup_tables", "select id, case observed_property when 'rainfall' then 0.5 when 'pore_pressure' then 5.0 when 'soil_moisture' then 0.02 when 'displacement' then 1.0 when 'velocity' then 3.0 end::double as sigma from fx_obs")
def _(fx):
    from slopewatch.params import PARAMS

    return fx["fx_obs"].select("id", B.lookup(PARAMS["sensor"]["sigma"], "observed_property").alias("sigma"))


@query("fn6_spatial_block", "select cell_id, concat_ws('|', cast(floor(lon / 0.05) as bigint), cast(floor(lat / 0.05) as bigint)) as block from fx_cells")
def _(fx):
    return fx["fx_cells"].select("cell_id", B.spatial_block("lon", "lat", 0.05).alias("block"))


@query("fn29_conditionals", "select cell_id, coalesce(susc_ispra, -1) as a, least(slope_deg, 20) as b, greatest(iffi_density_500, 3) as c, case when pai_class_norm is null then 'none' else 'some' end as d from fx_static")
def _(fx):
    return fx["fx_static"].select(
        "cell_id", F.coalesce("susc_ispra", F.lit(-1.0)).alias("a"), F.least("slope_deg", F.lit(20.0)).alias("b"), F.greatest("iffi_density_500", F.lit(3.0)).alias("c"),
        F.when(F.col("pai_class_norm").isNull(), "none").otherwise("some").alias("d"),
    )


@query("join22_sensor_latest", f"select site_id, epoch_us(bucket) as bucket_us from (select *, row_number() over (partition by site_id order by bucket desc) as rn from ({MERGED}) m) t where rn = 1")
def _(fx):
    last = latest_per_key(merged_features(fx), ["site_id"], ["bucket"])
    return last.select("site_id", B.epoch_us("bucket").alias("bucket_us"))
