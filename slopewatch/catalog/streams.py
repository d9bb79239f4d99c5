"""Queries that run a stream over the event table, each against its batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.catalog.registry import Frames, query
from slopewatch.catalog.rollups import AS_OF_SQL, HIGH, LATEST, as_of, r6
from slopewatch.catalog.series import FEATURES, QC
from slopewatch.catalog.spatial import area_boxes, radar_peaks
from slopewatch.functions import basic as B
from slopewatch.operators.rollup import latest_state
from slopewatch.sources.features import radar_pixels
from slopewatch.streaming import alerts as A
from slopewatch.session import shared_path
from slopewatch.streaming import ingest as I
from slopewatch.streaming.late import USED, HourStore


def table_stream(fx: Frames, name: str):
    """One parquet table as a file stream."""
    return fx.spark.readStream.schema(fx[name].schema).option("pathGlobFilter", f"{name}.parquet").load(fx.sf_dir, format="parquet")


def landed(fx: Frames, batches: int = 3):
    """The observations as they arrive: three batches dealt by id, so that most rows of the later ones come days late."""
    base = shared_path(fx.spark, "landed")
    for b in range(batches):  # files are taken in the order of their times
        fx["fx_obs"].filter(F.col("id") % batches == b).coalesce(1).write.parquet(f"{base}/b{b}")
    rows = fx.spark.readStream.schema(fx["fx_obs"].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(base)
    return rows.withColumns({"device_id": F.col("device_id").cast("string"), "phenomenon_time": F.col("phenomenon_time").cast("timestamp"), "quality": F.lit("ok")})


def hour_store(fx: Frames):
    return HourStore(fx.spark, shared_path(fx.spark, "hours")).run(landed(fx))


PROPERTY = {"view": "rainfall", "click": "pore_pressure", "purchase": "soil_moisture", "signup": "displacement", "error": "velocity"}


def observation_stream(fx: Frames):
    e = table_stream(fx, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("device_id"), B.lookup(PROPERTY, "event_type").alias("observed_property"),
        F.col("ts").cast("timestamp").alias("phenomenon_time"), F.col("value").alias("result_value"),
    )


def messages(events):
    """Broker messages as the events would send them, some of them broken."""
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    topic = F.when(e % 29 == 0, F.concat(F.lit("hazard/v1/r/s/"), u)).otherwise(
        F.concat(F.lit("hazard/v1/r/s/"), F.when(e % 31 == 0, F.lit("other")).otherwise(u), F.lit("/ds/obs"))
    )
    prop = B.lookup(PROPERTY, "event_type")
    from slopewatch.params import PARAMS

    body = F.struct(
        F.lit("v1").alias("contract_version"), u.alias("thing_id"), prop.alias("observed_property"),
        F.when(e % 37 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("phenomenon_time"),
        F.col("value").alias("result_value"), F.when(e % 41 == 0, "furlong").otherwise(B.lookup(PARAMS["sensor"]["unit"], prop)).alias("result_unit"),
        F.when(e % 43 == 0, 1).alias("surprise"),
    )
    return events.select("event_id", topic.alias("topic"), F.to_json(body).alias("payload"))


def devices(fx: Frames):
    c = F.col("c_custkey")
    cal = F.create_map(F.lit("rainfall"), F.struct(F.lit(2.0).alias("scale"), F.lit(1.0).alias("offset")))
    return fx["customer"].filter(c % 7 != 3).select(
        c.cast("string").alias("device_id"), F.when(c % 11 == 0, "quarantined").otherwise("online").alias("status"), c.alias("cell_id"), cal.alias("calibration")
    )


REJECT = """case when event_id % 29 = 0 then 'bad_topic' when event_id % 37 = 0 or event_id % 43 = 0 then 'bad_payload' when event_id % 31 = 0 then 'thing_mismatch'
    when user_id % 7 = 3 or user_id not in (select c_custkey from customer) then 'unknown_device' when user_id % 11 = 0 then 'quarantined' else 'accepted' end"""


@query("str1_str2_contract", f"select event_id, {REJECT} as outcome from events")
def _(fx):
    out = I.enrich(I.parse(messages(table_stream(fx, "events"))), devices(fx))
    rows = I.drain(out.select("event_id", F.coalesce("reject", F.lit("accepted")).alias("outcome")), "contract")
    return rows.drop("batch_id")


@query("str3_enriched", f"select event_id, user_id as cell_id, round(case when event_type = 'view' then value * 2 + 1 else value end, 6) as value, event_id % 41 = 0 as bad_unit from events where {REJECT} = 'accepted'")
def _(fx):
    good, _ = I.split_rejects(I.enrich(I.parse(messages(table_stream(fx, "events"))), devices(fx)))
    rows = I.drain(good.select("event_id", "cell_id", r6(F.col("result_value"), "value"), "bad_unit"), "enriched")
    return rows.drop("batch_id")


@query("str4_udf4_quality_state", f"with {QC} select id, quality from f")
def _(fx):
    return I.drain(I.stream_quality(observation_stream(fx)), "quality").select("id", "quality")


@query("str5_last_seen", "select cast(device_id as varchar) as device_id, max(epoch_us(phenomenon_time)) as us from fx_obs group by device_id")
def _(fx):
    seen = I.drain_latest(I.last_seen(observation_stream(fx)), "seen", ["device_id"])
    return seen.select("device_id", B.epoch_us("last_seen_at").alias("us"))


HOURLY = FEATURES.format(key="device_id", unit="hour", source="fx_obs", ok="")


@query("str6_hourly_rollup", f"select cast(device_id as varchar) as device_id, epoch_us(bucket) as bucket_us, round(rainfall_mm, 4) as rainfall_mm, round(pore_pressure_kpa, 4) as pore_pressure_kpa, displacement_mm, sample_count, last_us from ({HOURLY}) h")
def _(fx):
    return hour_store(fx).hours().select(
        "device_id", B.epoch_us("bucket").alias("bucket_us"), F.round("rainfall_mm", 4).alias("rainfall_mm"), F.round("pore_pressure_kpa", 4).alias("pore_pressure_kpa"),
        "displacement_mm", "sample_count", B.epoch_us("last_observation_at").alias("last_us"),
    )


@query("str7_motion_after_batch", f"with h as ({HOURLY}), p as (select *, last_value(velocity_mmd ignore nulls) over (partition by device_id order by bucket rows between unbounded preceding and 1 preceding) as pv from h) select cast(device_id as varchar) as device_id, epoch_us(bucket) as bucket_us, round(coalesce(pv, -1), 6) as prev_velocity, round(coalesce(velocity_mmd, -1), 6) as velocity_mmd from p")
def _(fx):
    from slopewatch.operators.sensors import with_motion

    m = with_motion(hour_store(fx).hours(), "device_id")
    return m.select("device_id", B.epoch_us("bucket").alias("bucket_us"), *[r6(F.coalesce(c, F.lit(-1.0)), c) for c in ("prev_velocity", "velocity_mmd")])


def greedy(source: str, key: str, hours: int) -> str:
    w = hours * 3_600_000_000
    return f"""with recursive s as materialized (select distinct {key} as k, us from {source} q), g as (select k, min(us) as us from s group by k
      union all select t.k, t.us from (select g.k, (select min(s.us) from s where s.k = g.k and s.us > g.us + {w}) as us from g) t where t.us is not null)
    select k as {key}, us from g"""


ALERT_ROWS = "(select o_custkey as cell_id, epoch_us(o_orderdate) as us from orders where o_totalprice / cast(500009 as double) >= 0.55)"


@query("str8_alert_dedup", greedy(ALERT_ROWS, "cell_id", 24 * 120))
def _(fx):
    hot = fx["fx_rated"].filter(F.col("level").isin("High", "VeryHigh")).select("cell_id", F.col("computed_at").alias("ts"))
    return A.suppress_batch(hot, "cell_id", 60 * 24 * 120).select("cell_id", "us")


@query("str8_alert_dedup_stream", greedy("(select user_id, epoch_us(ts) as us from events where value > 20)", "user_id", 3))
def _(fx):
    rows = table_stream(fx, "events").filter(F.col("value") > 20).select("user_id", "ts", F.col("event_id").alias("id"))
    sent = I.drain(A.suppress_stream(rows, "user_id", 180), "dedup")
    return sent.select(F.col("user_id").cast("bigint").alias("user_id"), B.epoch_us("ts").alias("us"))


@query("str9_forecast_dedup", greedy("(select c_nationkey as istat, epoch_us(o_orderdate) as us from orders join customer on c_custkey = o_custkey where o_totalprice / cast(500009 as double) >= 0.55)", "istat", 24 * 30))
def _(fx):
    place = fx["customer"].select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("istat"))
    rows = fx["fx_rated"].filter(B.at_least("level", "High")).join(place, "cell_id").select("istat", F.col("computed_at").alias("ts"))
    return A.suppress_batch(rows, "istat", 60 * 24 * 30).select("istat", "us")


@query("str10_nowcast_trigger", """with b as (select aoi_id, min(lon) - 0.005 as x0, min(lat) - 0.005 as y0, max(lon) + 0.005 as x1, max(lat) + 0.005 as y1 from fx_cells group by aoi_id),
    p as (select b.aoi_id, max(r.mm_h) as peak, count(*) filter (where r.mm_h >= 30) as hot from b join fx_radar r on r.mm_h > -9999 and r.x between b.x0 and b.x1 and r.y between b.y0 and b.y1 group by b.aoi_id)
    select aoi_id, round(peak, 3) as peak, hot as hot_pixels from p where peak >= 30 and hot >= 3""")
def _(fx):
    return A.nowcast_triggers(radar_peaks(radar_pixels(fx["fx_radar"]), area_boxes(fx)), 30.0, 3)


@query("str11_antecedent_windows", "with h as (select user_id, epoch_us(ts) as us, value from events where event_type = 'view') select cast(user_id as varchar) as series_id, (floor(us / 3600000000) + i) * 3600000000::bigint as as_of_us, round(sum(value), 4) as mm, count(*) as n from h, range(1, 25) r(i) group by all")
def _(fx):
    w = hour_store(fx).rain_windows(24)
    return w.select(F.col("device_id").alias("series_id"), B.epoch_us("as_of").cast("double").alias("as_of_us"), F.round("mm", 4).alias("mm"), "n")


@query("str12_late_recompute", f"""select cast(device_id as varchar) as device_id, epoch_us(bucket) as bucket_us, sample_count, round(rainfall_mm, 4) as rainfall_mm, round(soil_moisture, 4) as soil_moisture,
    displacement_mm, round(velocity_mmd, 4) as velocity_mmd, last_us from ({HOURLY}) h
    where exists (select 1 from fx_obs o where o.device_id = h.device_id and date_trunc('hour', o.phenomenon_time) = h.bucket and o.id % 3 > 0 and o.observed_property <> 'velocity')""")
def _(fx):
    # the hours that rows of the second and third batch reached
    out = hour_store(fx).hours()
    late = fx["fx_obs"].filter((F.col("id") % 3 > 0) & F.col("observed_property").isin(*USED)).select(F.col("device_id").cast("string").alias("device_id"), F.date_trunc("hour", "phenomenon_time").cast("timestamp").alias("bucket"))
    return out.join(late, ["device_id", "bucket"], "left_semi").select(
        "device_id", B.epoch_us("bucket").alias("bucket_us"), "sample_count", F.round("rainfall_mm", 4).alias("rainfall_mm"), F.round("soil_moisture", 4).alias("soil_moisture"),
        "displacement_mm", F.round("velocity_mmd", 4).alias("velocity_mmd"), B.epoch_us("last_observation_at").alias("last_us"),
    )


@query("str13_latest_upkeep", f"select cell_id, id from {LATEST} l")
def _(fx):
    # two batches merged into the latest table, as after each run
    rows = fx["fx_rated"].select("cell_id", "computed_at", "id")
    day = F.lit("1998-01-01").cast("timestamp_ntz")
    first = latest_state(rows.filter(F.col("computed_at") < day).withColumn("horizon", F.lit("24h"))).drop("horizon")
    return I.merge_latest(first, rows.filter(F.col("computed_at") >= day), ["cell_id"], ["computed_at", "id"]).select("cell_id", "id")


@query("join24_not_recently_sent", f"select distinct cell_id from fx_rated where {HIGH} and computed_at >= {AS_OF_SQL} - interval 100 days and cell_id not in (select cell_id from fx_rated where level = 'VeryHigh' and computed_at >= {AS_OF_SQL} - interval 60 days)")
def _(fx):
    hot = fx["fx_rated"].filter(F.col("level").isin("High", "VeryHigh") & (F.col("computed_at") >= as_of() - F.make_dt_interval(days=F.lit(100)))).select("cell_id").distinct()
    ledger = fx["fx_rated"].filter(F.col("level") == "VeryHigh").select("cell_id", F.col("computed_at").alias("ts"))
    return A.not_recently_sent(hot, ledger, "cell_id", as_of(), 60 * 24 * 60)


