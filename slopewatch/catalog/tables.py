"""Queries over sources, sinks, merges and text, each on payloads derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.catalog.registry import Frames, query
from slopewatch.catalog.rollups import AS_OF_SQL, HIGH, LATEST, STATE, as_of, r6, state
from slopewatch.catalog.scoring import sig
from slopewatch.catalog.spatial import ZONES, edges, high_zones, rings
from slopewatch.functions import basic as B
from slopewatch.functions import text as TX
from slopewatch.operators import relational as R
from slopewatch.operators import rollup as U
from slopewatch.session import shared_path
from slopewatch.sinks import tables as K
from slopewatch.sinks.bucketed import BucketedTable
from slopewatch.sources import features as SF
from slopewatch.sources import weather as SW


def feature(props: list, geometry=None, ident=None):
    """GeoJSON text of a row."""
    parts = [F.lit("Feature").alias("type")]
    if ident is not None:
        parts.append(ident.alias("id"))
    return F.to_json(F.struct(*parts, F.struct(*props).alias("properties"), (geometry if geometry is not None else F.lit(None).cast("string")).alias("geometry")))


def point(x, y):
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


# --- sources --------------------------------------------------------------------------
@query("src1_region_seed", "select concat('it-', r_regionkey) as aoi_id, r_name as name, 'region' as kind, cast(r_regionkey as varchar) as code from region")
def _(fx):
    rows = fx["region"].select(feature([F.concat(F.lit("it-"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("code")]).alias("feature"))
    out = SF.region_seed(rows)
    return out.select("aoi_id", "name", "kind", F.element_at("metadata", "code").alias("code"))


CATALOGUE = """select case when event_id % 11 = 0 then '' else cast(event_id as varchar) end as id, case when event_id % 13 = 0 then 'n.d.' else cast(event_id % 90 as varchar) end as lon, cast(event_id % 45 as varchar) as lat,
    case when event_id % 3 = 0 then strftime(event_time, '%d/%m/%Y') when event_id % 17 = 0 then '2001-01-01' else strftime(event_time, '%d/%m/%Y %H:%M') end as utc_date, event_time, event_id from fx_slides"""


@query("src2_event_catalogue", f"select cast(event_id as varchar) as id, cast(event_id % 90 as double) as lon, cast(event_id % 45 as double) as lat, epoch_us(case when event_id % 3 = 0 then date_trunc('day', event_time)::timestamp else date_trunc('minute', event_time) end) as us from ({CATALOGUE}) c where id <> '' and lon <> 'n.d.' and utc_date <> '2001-01-01'")
def _(fx):
    e = F.col("event_id")
    date = F.when(e % 3 == 0, F.date_format("event_time", "dd/MM/yyyy")).when(e % 17 == 0, "2001-01-01").otherwise(F.date_format("event_time", "dd/MM/yyyy HH:mm"))
    raw = fx["fx_slides"].select(
        F.when(e % 11 == 0, "").otherwise(e.cast("string")).alias("id"), F.when(e % 13 == 0, "n.d.").otherwise((e % 90).cast("string")).alias("lon"),
        (e % 45).cast("string").alias("lat"), date.alias("utc_date"),
    )
    good, _ = SF.event_catalogue(raw)
    return good.select("id", "lon", "lat", B.epoch_us("event_time").alias("us"))


@query("src2_catalogue_rejects", f"select (select count(*) from fx_slides) - count(*) as skipped from ({CATALOGUE}) c where id <> '' and lon <> 'n.d.' and utc_date <> '2001-01-01'")
def _(fx):
    e = F.col("event_id")
    date = F.when(e % 3 == 0, F.date_format("event_time", "dd/MM/yyyy")).when(e % 17 == 0, "2001-01-01").otherwise(F.date_format("event_time", "dd/MM/yyyy HH:mm"))
    raw = fx["fx_slides"].select(F.when(e % 11 == 0, "").otherwise(e.cast("string")).alias("id"), F.when(e % 13 == 0, "n.d.").otherwise((e % 90).cast("string")).alias("lon"), (e % 45).cast("string").alias("lat"), date.alias("utc_date"))
    return SF.event_catalogue(raw)[1].agg(F.count(F.lit(1)).alias("skipped"))


def payloads(fx: Frames):
    """One weather answer per series and day, as its hourly arrays."""
    r = fx["fx_rain"].withColumn("day", F.date_trunc("day", "ts"))
    packed = r.groupBy("series_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "mm"))).alias("a"))
    times = F.transform("a", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm"))
    rain = F.transform("a", lambda x: F.when(x["mm"] > 0, x["mm"]))
    body = F.struct(F.struct(times.alias("time"), rain.alias("precipitation"), rain.alias("wave_height")).alias("hourly"), F.struct(rain.alias("precipitation_sum"), rain.alias("river_discharge")).alias("daily"))
    return packed.select("series_id", "day", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


@query("src3_hourly_samples", "select series_id, epoch_us(ts) as us, round(mm, 6) as mm from fx_rain")
def _(fx):
    s = SW.hourly_samples(payloads(fx).drop("day"))
    return s.select("series_id", B.epoch_us("ts").alias("us"), r6(F.col("precipitation_mm"), "mm"))


@query("src4_snapshot_window", "select series_id, epoch_us(ts) as us from fx_rain where ts between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-12'")
def _(fx):
    s = SW.hourly_samples(payloads(fx).drop("day"))
    w = SW.window(s, F.lit("2024-01-05 06:00:00").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))
    return w.select("series_id", B.epoch_us("ts").alias("us"))


@query("src5_node_series", "select series_id, epoch_us(ts) as us, round(mm, 6) as mm from fx_rain")
def _(fx):
    # odd series answer with a bare object, even ones with a list
    p = payloads(fx).withColumn("payload", F.when(F.col("series_id") % 2 == 0, F.concat(F.lit("["), "payload", F.lit("]"))).otherwise(F.col("payload")))
    return SW.node_series(p.drop("day")).select("series_id", B.epoch_us("ts").alias("us"), r6(F.col("mm"), "mm"))


@query("src6_trailing_total", "select series_id, epoch_us(date_trunc('day', ts)::timestamp) as us, round(sum(mm), 4) as total_mm from fx_rain group by all")
def _(fx):
    return SW.trailing_total(payloads(fx)).select("series_id", B.epoch_us("day").alias("us"), F.round("total_mm", 4).alias("total_mm"))


@query("src7_flood_signals", """with s as (select series_id, date_trunc('day', ts)::timestamp as day, ts, mm from fx_rain where mm > 0), n as (select *, row_number() over (partition by series_id, day order by ts desc) as back, count(*) over (partition by series_id, day) as n from s)
    select series_id, epoch_us(day) as us, round(sum(mm), 4) as rain, round(case when max(n) >= 8 then max(mm) filter (where back <= 7) / avg(mm) filter (where back > 7) end, 4) as ratio, round(least(1.0, max(mm) / 4.0), 4) as surge from n group by series_id, day""")
def _(fx):
    out = SW.flood_signals(payloads(fx)).filter(F.col("rain_72h_mm").isNotNull())
    return out.select("series_id", B.epoch_us("day").alias("us"), F.round("rain_72h_mm", 4).alias("rain"), F.round("discharge_ratio", 4).alias("ratio"), F.round("coastal_surge", 4).alias("surge"))


@query("src8_seismic_reader", "select cast(event_id as varchar) as id, epoch_us(date_trunc('second', ts)) as us, cast(event_id % 70 as double) / 10 as magnitude, cast(event_id % 20 as double) as lon from events where event_id % 7 <> 0 and event_id % 9 <> 0")
def _(fx):
    e = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    props = [
        F.when(e % 2 == 0, e.cast("string")).alias("eventID"), F.when(e % 2 == 1, e.cast("string")).alias("eventId"),
        F.when(e % 3 == 0, stamp).alias("time"), F.when(e % 3 == 1, stamp).alias("origintime"), F.when(e % 3 == 2, stamp).alias("origin_time"),
        F.when(e % 7 != 0, (e % 70).cast("double") / 10).alias("mag"),
    ]
    rows = fx["events"].select(feature(props, F.when(e % 9 != 0, point((e % 20).cast("double"), (e % 30).cast("double")))).alias("feature"))
    return SF.seismic(rows).select("id", B.epoch_us("origin_time").alias("us"), "magnitude", "lon")


def fire_features(fx: Frames):
    g = F.col("geom_id")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (g % 900).cast("int")), "yyyy-MM-dd")
    j = fx["fx_hazard"].join(rings(fx).hint("merge"), "geom_id")  # shuffled: a small file is few tasks
    closed = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.array(p["xs"], p["ys"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    props = [
        F.when(g % 2 == 0, F.concat(day, F.lit("T10:00:00"))).alias("FIREDATE"), F.when(g % 2 == 1, F.when(g % 5 == 0, "unknown").otherwise(day)).alias("firedate"),
        (g % 100).alias("AREA_HA"), F.lit("IT").alias("COUNTRY"),
    ]
    return j.select(feature(props, F.when(g % 10 != 3, geometry), F.when(g % 8 != 1, g.cast("string"))).alias("feature"))


FIRES = "(select *, case when geom_id % 2 = 1 and geom_id % 5 = 0 then null else date '2020-01-01' + cast(geom_id % 900 as int) end as d from fx_hazard where geom_id % 8 <> 1 and geom_id % 10 <> 3)"


@query("src9_burnt_areas", f"select cast(geom_id as varchar) as id, coalesce(cast(d as varchar), 'none') as day, cast(geom_id % 100 as double) as area_ha from {FIRES} f")
def _(fx):
    return SF.burnt_areas(fire_features(fx)).select("id", F.coalesce(F.col("fire_date").cast("string"), F.lit("none")).alias("day"), "area_ha")


@query("src10_perimeter_archive", f"select cast(geom_id as varchar) as id from {FIRES} f where cx - rx <= 10.3 and cx + rx >= 10.1 and cy - ry <= 38.25 and cy + ry >= 38.05 and d between date '2020-03-01' and date '2021-06-30'")
def _(fx):
    b = SF.with_bbox(SF.burnt_areas(fire_features(fx)))
    return SF.perimeters_in(b, (10.1, 38.05, 10.3, 38.25), "2020-03-01", "2021-06-30").select("id")


@query("src11_inventory_reader", "select cast(id as varchar) as id, movement_code as movement_type, cast(date '2001-01-01' + cast(id % 400 as int) as varchar) as day from fx_inventory where id % 6 <> 5")
def _(fx):
    i = F.col("id")
    day = F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (i % 400).cast("int")), "yyyy-MM-dd")
    props = [
        F.when(i % 2 == 0, i.cast("string")).alias("id_frana"), F.when(i % 2 == 1, i.cast("string")).alias("iffi_id"),
        F.when(i % 3 == 0, F.col("movement_code")).alias("movimento"), F.when(i % 3 != 0, F.col("movement_code")).alias("mov_principale"), day.alias("data_evento"),
    ]
    rows = fx["fx_inventory"].select(feature(props, F.when(i % 6 != 5, point(F.col("x"), F.col("y")))).alias("feature"))
    return SF.inventory(rows).select("id", "movement_type", F.col("occurrence_date").cast("string").alias("day"))


@query("src12_hazard_reader", "select cast(geom_id as varchar) as id, hazard_class, authority from fx_hazard")
def _(fx):
    g, c = F.col("geom_id"), F.col("hazard_class")
    props = [F.when(g % 2 == 0, F.concat(F.lit(" "), F.lower(c))).alias("classe_pai"), F.when(g % 2 == 1, F.when(c == "UNKNOWN", "Pn.d.").otherwise(c)).alias("pericolosita"), F.col("authority").alias("autorita"), g.alias("id_pai")]
    rows = fx["fx_hazard"].select(feature(props, point(F.col("cx"), F.col("cy"))).alias("feature"))
    return SF.hazard_polygons(rows).select("id", "hazard_class", "authority")


@query("src13_inventory_union", "select concat('frane_poly_puglia_opendata:', geom_id) as id, 'frane_poly' as family from fx_hazard union all select concat('frane_line_puglia_opendata:', md5(concat_ws(' ', id, kind))), 'frane_line' from fx_network")
def _(fx):
    poly = fx["fx_hazard"].select(F.col("geom_id").alias("fid"), F.col("label").alias("nome_tipo"), F.encode("label", "utf-8").alias("wkb"))
    line = fx["fx_network"].select(F.encode(F.concat_ws(" ", "id", "kind"), "utf-8").alias("wkb"))
    return SF.inventory_union({"frane_poly": poly, "frane_line": line}, "puglia").select("id", "family")


@query("src14_hazard_mosaic", "select geom_id, hazard_class from fx_hazard where hazard_class <> 'UNKNOWN' and cx - rx <= 10.4 and cx + rx >= 10.1 and cy - ry <= 38.4 and cy + ry >= 38.1")
def _(fx):
    cx, cy, rx, ry = (F.col(c) for c in ("cx", "cy", "rx", "ry"))
    named = F.when(F.col("hazard_class") == "AA", "Aree di Attenzione AA").otherwise(F.concat(F.lit("Elevata "), F.lower("hazard_class")))
    m = fx["fx_hazard"].select("geom_id", named.alias("label"), (cx - rx).alias("minx"), (cy - ry).alias("miny"), (cx + rx).alias("maxx"), (cy + ry).alias("maxy"))
    return SF.hazard_mosaic(m, (10.1, 38.1, 10.4, 38.4)).select("geom_id", "hazard_class")


@query("src15_flood_mosaic", "select geom_id, case when geom_id % 3 = 0 then 'P3' when geom_id % 3 = 1 then 'P2' else 'P1' end as hazard_class from fx_hazard")
def _(fx):
    h = fx["fx_hazard"].select("geom_id")
    names = ["mosaicatura_idraulica_elevata", "mosaicatura_idraulica_media", "mosaicatura_idraulica_bassa"]
    return SF.flood_mosaic({n: h.filter(F.col("geom_id") % 3 == i) for i, n in enumerate(names)}).select("geom_id", "hazard_class")


@query("src16_code_dictionary", "select cast(n_nationkey as varchar) as code, n_name as label from nation")
def _(fx):
    n, k = fx["nation"], F.col("n_nationkey").cast("string")
    as_map = n.filter(F.col("n_nationkey") < 12).groupBy().agg(F.map_from_entries(F.collect_list(F.struct(k, "n_name"))).alias("m")).select(F.to_json("m").alias("payload"))
    item = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("code"), k, F.lit("label"), F.col("n_name"))).otherwise(F.create_map(F.lit("id"), k, F.lit("description"), F.col("n_name")))
    as_list = n.filter(F.col("n_nationkey") >= 12).groupBy().agg(F.to_json(F.collect_list(item)).alias("payload"))
    return SF.code_dictionary(as_map.unionByName(as_list))


@query("src17_composite_inventory", "select concat('puglia|', id, '|piff_poly') as id, cast(id as varchar) as iffi_id, 'piff_poly' as geom_type from fx_inventory")
def _(fx):
    rows = fx["fx_inventory"].select(F.col("id").cast("string").alias("id"), "movement_code")
    return SF.composite_inventory(rows, "puglia", "IFFI_puglia_PIFF_poly").select("id", "iffi_id", "geom_type")


@query("src18_hazard_import", "select geom_id as id, case when geom_id % 2 = 0 then 'P4' else hazard_class end as hazard_class from fx_hazard where geom_id % 2 = 0 or geom_id % 3 <> 0")
def _(fx):
    h = fx["fx_hazard"]
    old = h.select(F.col("geom_id").alias("id"), "hazard_class", F.when(F.col("geom_id") % 3 != 0, 1).alias("dataset_version"))
    new = h.filter(F.col("geom_id") % 2 == 0).select(F.col("geom_id").alias("id"), F.lit("P4").alias("hazard_class"), F.lit(2).alias("dataset_version"))
    return SF.hazard_import(old, new, national=True).select("id", "hazard_class")


@query("src19_network_lines", "select id % 4 as c, cast(count(*) as bigint) as segments, round(sum(x1), 6) as sx from (select id, x1 from fx_faults union all select id, x2 as x1 from fx_faults where id % 3 = 0) t group by id % 4")
def _(fx):
    i = F.col("id")
    a, b, c = F.array("x1", "y1"), F.array("x2", "y2"), F.array(F.col("x2") + 0.01, F.col("y2"))
    multi = F.struct(F.lit("MultiLineString").alias("type"), F.array(F.array(a, b), F.array(b, c)).alias("coordinates"))
    single = F.struct(F.lit("LineString").alias("type"), F.array(a, b).alias("coordinates"))
    g = F.when(i % 3 == 0, F.to_json(multi)).otherwise(F.to_json(single))
    text = F.concat(F.lit('{"type":"Feature","properties":{"fclass":"'), (i % 4).cast("string"), F.lit('"},"geometry":'), g, F.lit("}"))
    seg = SF.line_segments(SF.network_lines(fx["fx_faults"].select(text.alias("feature"))))
    return seg.groupBy(F.col("class").cast("bigint").alias("c")).agg(F.count(F.lit(1)).alias("segments"), r6(F.sum("x1"), "sx"))


@query("src20_scatterers", "select cast(coalesce(case when event_id % 3 <> 0 then event_id % 10 end, -1) as double) as accel, count(*) as n, round(sum(value), 4) as v from events where event_id % 5 <> 0 group by 1")
def _(fx):
    e = F.col("event_id")
    props = [F.when(e % 5 == 0, "bad").otherwise(F.col("value").cast("string")).alias("velocity_mmy"), F.when(e % 3 != 0, e % 10).alias("acceleration")]
    rows = fx["events"].select(feature(props, point(F.lit(10.5), F.lit(38.5))).alias("feature"))
    accel = F.coalesce("accel_mmy2", F.lit(-1.0)).alias("accel")
    return SF.scatterers(rows).groupBy(accel).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("velocity_mmy"), 4).alias("v"))


@query("src21_radar_pixels", "select event_id, mm_h from fx_radar where mm_h > -9999")
def _(fx):
    return SF.radar_pixels(fx["fx_radar"]).select("event_id", "mm_h")


@query("src22_clipped_pixels", "select c.cell_id, count(*) as n from fx_radar r join fx_cells c on r.x + 0.001 >= c.lon - 0.005 and r.x + 0.001 < c.lon + 0.005 and r.y + 0.001 >= c.lat - 0.005 and r.y + 0.001 < c.lat + 0.005 group by c.cell_id")
def _(fx):
    px = fx["fx_radar"].select("event_id", (F.col("x") + 0.001).alias("x"), (F.col("y") + 0.001).alias("y"))
    return SF.clip_pixels(px, fx["fx_cells"]).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


KINDS = "case doc_id % 7 when 0 then '.paper.md' when 1 then '.paper.txt' when 2 then '.pai.md' when 3 then '.ispra.md' when 4 then '.iffi.md' when 5 then '.briefing.md' else '.bin' end"


@query("src23_txt3_corpus", f"select doc_id, case doc_id % 7 when 0 then 'paper' when 1 then 'paper' when 2 then 'pai_plan' when 3 then 'ispra_report' when 4 then 'iffi_event' else 'briefing' end as kind from documents where doc_id % 7 <> 6 and length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0")
def _(fx):
    raw = fx["documents"].select(F.concat(F.lit("/corpus/Doc"), "doc_id", F.expr(KINDS)).alias("source"), F.col("text").alias("content"), "doc_id")
    return SF.typed_documents(raw).select("doc_id", "kind")


@query("src24_municipality_boundaries", "select cast(n_nationkey as varchar) as istat_code, n_name as name from nation where n_nationkey % 6 <> 0")
def _(fx):
    n = fx["nation"].select(F.col("n_nationkey").alias("pro_com"), F.concat(F.lit(" "), "n_name").alias("comune"), F.when(F.col("n_nationkey") % 6 != 0, "POLYGON").alias("geometry"))
    return SF.municipalities(n).select("istat_code", "name")


@query("src26_labelled_polygons", "select p_name as label, count(*) as n from part where p_partkey % 4 <> 0 group by p_name")
def _(fx):
    p = fx["part"].select("p_partkey", "p_name", F.when(F.col("p_partkey") % 4 != 0, "POLYGON").alias("geometry"))
    return SF.labelled_polygons(p, "litologia").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- sinks ---------------------------------------------------------------------------------
@query("snk1_assessment_rows", f"select id, cell_id, epoch_us({AS_OF_SQL}) as us, '2001-08-01' as run_date, 'observed' as kind from fx_bundle")
def _(fx):
    from slopewatch.catalog.scoring import bundle
    from slopewatch.functions.scoring import score

    scored = score(bundle(fx)).withColumns({"aoi_id": F.lit("all"), "cell_id": F.struct("id", "cell_id")})
    rows = K.assessment_rows(scored, as_of())
    return rows.select("cell_id.id", "cell_id.cell_id", B.epoch_us("computed_at").alias("us"), F.col("run_date").cast("string").alias("run_date"), "kind")


@query("snk2_coalescing_merge", "select coalesce(n.cell_id, o.cell_id) as cell_id, coalesce(n.susc_ispra, o.susc_ispra) as susc_ispra, o.slope_deg from (select cell_id, susc_ispra, slope_deg from fx_static where cell_id % 4 <> 0) o full join (select cell_id, case when cell_id % 3 = 1 then 0.5 end::double as susc_ispra from fx_static where cell_id % 5 <> 0) n on n.cell_id = o.cell_id")
def _(fx):
    old = fx["fx_static"].filter(F.col("cell_id") % 4 != 0).select("cell_id", "susc_ispra", "slope_deg", F.create_map(F.lit("a"), F.lit("1")).alias("extras"))
    new = fx["fx_static"].filter(F.col("cell_id") % 5 != 0).select("cell_id", F.when(F.col("cell_id") % 3 == 1, 0.5).alias("susc_ispra"), F.create_map(F.lit("b"), F.lit("2")).alias("extras"))
    return K.upsert_static(old, new).select("cell_id", "susc_ispra", "slope_deg")


@query("snk3_replacing_merge", "select p_partkey, case when p_partkey % 3 = 0 then 'new' else p_brand end as brand from part")
def _(fx):
    old = fx["part"].select("p_partkey", F.col("p_brand").alias("brand"))
    new = fx["part"].filter(F.col("p_partkey") % 3 == 0).select("p_partkey", F.lit("new").alias("brand"))
    return R.merge_replacing(old, new, ["p_partkey"])


@query("snk4_insert_missing", "select p_partkey, case when p_partkey % 2 = 0 then 'old' else 'new' end as origin from part")
def _(fx):
    old = fx["part"].filter(F.col("p_partkey") % 2 == 0).select("p_partkey", F.lit("old").alias("origin"))
    return R.merge_missing(old, fx["part"].select("p_partkey", F.lit("new").alias("origin")), ["p_partkey"])


@query("snk5_replace_slice", "select a.id from fx_assess a where not (horizon like '+%' and cell_id in (select cell_id from fx_assess where horizon like '+%' and id % 3 = 0)) union all select id + 1000000000 from fx_assess where horizon like '+%' and id % 3 = 0")
def _(fx):
    old = fx["fx_assess"].select("id", "cell_id", "horizon")
    new = old.filter(F.col("horizon").startswith("+") & (F.col("id") % 3 == 0)).withColumn("id", F.col("id") + 1000000000)
    return K.upsert_forecast(old, new).select("id")


@query("snk6_replace_kind", "select id, kind from fx_network where kind = 'road' union all select id + 100000000, 'rail' from fx_network where kind = 'rail'")
def _(fx):
    old = fx["fx_network"].select("id", "kind")
    new = old.filter(F.col("kind") == "rail").withColumn("id", F.col("id") + 100000000)
    return R.replace_slice(old, new, ["kind"])


@query("snk7_keep_rain", "select cell_id, case when cell_id % 4 = 0 then 1.0 else 2.0 end::double as rain, 9.0::double as slope from fx_static")
def _(fx):
    old = fx["fx_static"].select("cell_id", F.when(F.col("cell_id") % 4 == 0, 1.0).alias("rain"), F.lit(3.0).alias("slope"))
    new = fx["fx_static"].select("cell_id", F.lit(2.0).alias("rain"), F.lit(9.0).alias("slope"))
    return K.upsert_samples(old, new, ["cell_id"])


@query("snk8_accumulating_merge", "select device_id, count(*) as n, epoch_us(max(phenomenon_time)) as us from fx_obs group by device_id")
def _(fx):
    agg = lambda df: df.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.max("phenomenon_time").alias("t"))
    o = fx["fx_obs"]
    out = R.merge_accumulating(agg(o.filter(F.col("id") % 2 == 0)), agg(o.filter(F.col("id") % 2 == 1)), ["device_id"], ["n"], ["t"])
    return out.select("device_id", "n", B.epoch_us("t").alias("us"))


def merged_twice(fx: Frames, old, new, keys: list[str], rule):
    """A bucketed table after two merges."""
    table = BucketedTable(fx.spark, shared_path(fx.spark, "bucketed"), old.schema, keys, buckets=16)
    table.merge(old, lambda _, rows: rows, "first")
    table.merge(new, rule, "second")
    return table.read()


@query("snk2_bucketed_merge", "select coalesce(n.cell_id, o.cell_id) as cell_id, coalesce(n.susc_ispra, o.susc_ispra) as susc_ispra, o.slope_deg from (select cell_id, susc_ispra, slope_deg from fx_static where cell_id % 4 <> 0) o full join (select cell_id, case when cell_id % 3 = 1 then 0.5 end::double as susc_ispra from fx_static where cell_id % 5 <> 0) n on n.cell_id = o.cell_id")
def _(fx):
    old = fx["fx_static"].filter(F.col("cell_id") % 4 != 0).select("cell_id", "susc_ispra", "slope_deg")
    new = fx["fx_static"].filter(F.col("cell_id") % 5 != 0).select("cell_id", F.when(F.col("cell_id") % 3 == 1, 0.5).alias("susc_ispra"), F.lit(None).cast("double").alias("slope_deg"))
    return merged_twice(fx, old, new, ["cell_id"], lambda o, n: R.merge_coalescing(o, n, ["cell_id"]))


@query("snk8_bucketed_merge", "select device_id, count(*) as n, epoch_us(max(phenomenon_time)) as us from fx_obs group by device_id")
def _(fx):
    agg = lambda df: df.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.max("phenomenon_time").alias("t"))
    o = fx["fx_obs"]
    out = merged_twice(fx, agg(o.filter(F.col("id") % 2 == 0)), agg(o.filter(F.col("id") % 2 == 1)), ["device_id"], lambda a, b: R.merge_accumulating(a, b, ["device_id"], ["n"], ["t"]))
    return out.select("device_id", "n", B.epoch_us("t").alias("us"))


@query("snk9_content_versions", """with h as (select o_orderstatus, sha256(to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderpriority': o_orderpriority})) as h from orders), c as (select o_orderstatus, h, count(*) as n from h group by all),
    w as (select o_orderstatus, sha256(concat_ws(':', h, n)) as e, n from c), x as (select o_orderstatus, bit_xor(('0x' || substr(e, 1, 15))::bigint) as w0, bit_xor(('0x' || substr(e, 16, 15))::bigint) as w1, bit_xor(('0x' || substr(e, 31, 15))::bigint) as w2, bit_xor(('0x' || substr(e, 46, 15))::bigint) as w3, cast(sum(n) as bigint) as rows from w group by o_orderstatus)
    select o_orderstatus, sha256(concat_ws('-', w0, w1, w2, w3)) as version, rows from x""")
def _(fx):
    return R.content_version(fx["orders"].select("o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority"), ["o_orderstatus"])


@query("snk9_skip_unchanged", "select o_orderstatus as dataset, o_orderstatus = 'F' as skip from orders group by o_orderstatus")
def _(fx):
    now = R.content_version(fx["orders"].select(F.col("o_orderstatus").alias("dataset"), "o_orderkey"), ["dataset"])
    known = now.withColumns({"version": F.when(F.col("dataset") == "F", F.col("version")).otherwise("stale"), "fetched_at": as_of()})
    return R.unchanged(now, known.select("dataset", "version", "fetched_at"), ["dataset"]).select("dataset", "skip")


@query("snk10_report_signature", f"select count(*) as zones, true as stable, true as told_apart, true as head_counts from {STATE} s")
def _(fx):
    zones = state(fx).select("cell_id", "score", "level")
    head = {"valuation_time": "2001-08-01T00:00:00", "diffuse": 0}
    # the same rows in another order and partitioning sign alike; one score more, one row less or another head does not
    rows = K.report_signature(zones, head)
    least = zones.agg(F.min("cell_id")).scalar()
    other = {
        "_same": K.report_signature(zones.repartition(5, "level"), head), "_less": K.report_signature(zones.filter(F.col("cell_id") != least), head),
        "_more": K.report_signature(zones.withColumn("score", F.col("score") + F.when(F.col("cell_id") == least, 0.01).otherwise(0.0)), head),
        "_head": K.report_signature(zones, {**head, "diffuse": 1}),
    }
    told = rows.withColumns({k: t.select("signature").scalar() for k, t in other.items()}).withColumn("zones", zones.agg(F.count(F.lit(1))).scalar())
    sign = F.col("signature")
    return told.select("zones", (sign == F.col("_same")).alias("stable"), ((sign != F.col("_less")) & (sign != F.col("_more"))).alias("told_apart"), (sign != F.col("_head")).alias("head_counts"))


@query("snk11_feature_lines", "select cast(geom_id as bigint) as id, hazard_class, authority, 5 as n_points, round(cx - rx, 6) as x0, round(cy - ry, 6) as y1 from fx_hazard where hazard_class <> 'UNKNOWN'")
def _(fx):
    df = fx["fx_hazard"].join(rings(fx), "geom_id")
    lines = K.export_hazard_features(df, K.ring_geometry(F.col("xs"), F.col("ys")))
    of = lambda path: F.get_json_object("value", f"$.{path}")
    points = F.size(F.from_json(of("geometry.coordinates[0]"), "array<array<double>>"))
    return lines.select(
        of("id").cast("bigint").alias("id"), of("properties.hazard_class").alias("hazard_class"), of("properties.authority").alias("authority"), points.alias("n_points"),
        F.round(of("geometry.coordinates[0][0][0]").cast("double"), 6).alias("x0"), F.round(of("geometry.coordinates[0][1][1]").cast("double"), 6).alias("y1"),
    )


@query("snk12_zone_collections", f"""with recursive {ZONES} select m.zone, row_number() over (partition by m.zone order by z.score desc, z.cell_id) as rank, z.cell_id, case when z.score >= 0.75 then 'VeryHigh' else 'High' end as level,
    round(z.score, 3) as score, round(z.lon - 0.005, 6) as west, round(z.lat + 0.005, 6) as north from z join m on m.cell_id = z.cell_id""")
def _(fx):
    # every feature as a reader of the collections finds it
    texts = K.zone_collections(high_zones(fx), per_text=7)
    lines = texts.select("zone", "part", F.posexplode(F.filter(F.split("text", "\n"), lambda t: t.startswith('{"type":"Feature",'))).alias("at", "line"))
    of = lambda path, kind: F.get_json_object("line", f"$.{path}").cast(kind)
    return lines.select(
        "zone", (F.col("part") * 7 + F.col("at") + 1).alias("rank"), of("properties.cell_id", "bigint").alias("cell_id"), of("properties.level", "string").alias("level"),
        of("properties.score", "double").alias("score"), F.round(of("geometry.coordinates[0][0][0]", "double"), 6).alias("west"), F.round(of("geometry.coordinates[0][2][1]", "double"), 6).alias("north"),
    )


@query("snk13_build_index", "select strftime(o_orderdate, '%Y-%m-%dT%H%MZ') as build_id, max(o_orderkey) as written_at, arg_max(o_custkey, o_orderkey) as zones from orders group by 1")
def _(fx):
    m = fx["orders"].select(B.build_id("o_orderdate").alias("build_id"), F.col("o_orderkey").alias("written_at"), F.col("o_custkey").alias("zones"))
    return K.build_index(m)


@query("snk14_prunable_builds", "select distinct b as build_id from (select strftime(o_orderdate, '%Y-%m-%dT%H%MZ') as b, dense_rank() over (order by strftime(o_orderdate, '%Y-%m-%dT%H%MZ') desc) as r from orders) t where r > 240")
def _(fx):
    return K.prunable_builds(fx["orders"].select(B.build_id("o_orderdate").alias("build_id")))


@query("snk15_retention", f"select count(*) filter (where computed_at >= {AS_OF_SQL} - interval 14 days) as kept, count(*) filter (where computed_at < {AS_OF_SQL} - interval 14 days) as expired from fx_assess")
def _(fx):
    kept, gone = K.retention_split(fx["fx_assess"], "computed_at", as_of(), 14)
    return kept.agg(F.count(F.lit(1)).alias("kept")).withColumn("expired", gone.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("snk16_month_partitions", "select cast(year(phenomenon_time) as int) as y, cast(month(phenomenon_time) as int) as m, count(*) as n from fx_obs group by all")
def _(fx):
    return K.by_month(fx["fx_obs"], "phenomenon_time").groupBy(F.col("year").alias("y"), F.col("month").alias("m")).agg(F.count(F.lit(1)).alias("n"))


@query("snk17_dataset_status", "select o_orderpriority as dataset, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as version from orders group by o_orderpriority")
def _(fx):
    reg = fx["orders"].select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderdate").alias("fetched_at"), F.col("o_orderkey").alias("version"))
    return K.status(reg).select("dataset", "version")


@query("snk18_instruction_rows", f"select aoi_id, count(*) as cells, count(*) filter (where {HIGH}) as high, 'B' as output from {STATE} s where aoi_id <> 'aoi-3' group by aoi_id")
def _(fx):
    brief = fx["fx_aoi"].select("aoi_id", F.when(F.col("aoi_id") != "aoi-3", "B").alias("briefing"))
    rows = K.instruction_rows(state(fx), brief, "Scrivi il bollettino.")
    at = lambda k: F.get_json_object("input", f"$.{k}").cast("bigint")
    return rows.select("aoi_id", at("celle_totali").alias("cells"), at("celle_high_o_superiori").alias("high"), "output")


# --- text ----------------------------------------------------------------------------------------
MORPH = "|".join(TX.NUMBER_MORPHEMES)
WORDS = "len(list_filter(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query("txt1_briefing_check", f"""select doc_id, {WORDS} as words, not ({WORDS} between 150 and 250) as bad_length, regexp_matches(text, '(?m)^[ \\t\\r\\f]*(?:[-*•]|#{{1,6}}\\s)') or regexp_matches(text, '\\n\\s*(?:[-*•]|#{{1,6}}\\s)') as bullets,
    lower(text) like '%emergenza%' as banned, len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')), lambda n: not list_contains(['7','24','28','30','48','60','72','90'], n) and not list_contains(['7','24','28','30','48','60','72','90'], replace(n, ',', '.')))) > 0 as unknown from documents""")
def _(fx):
    allowed = F.array(*[F.lit(n) for n in TX.STRUCTURAL_NUMBERS])
    c = fx["documents"].withColumn("c", TX.briefing_check(F.col("text"), allowed))
    has = lambda r: F.array_contains("c.violations", r)
    return c.select("doc_id", F.col("c.words").cast("bigint").alias("words"), has("length").alias("bad_length"), has("bullets").alias("bullets"), has("banned:emergenza").alias("banned"), has("unknown_numbers").alias("unknown"))


@query("txt2_allowed_numbers", """with n as (select event_id, unnest([printf('%.2f', v), printf('%.1f', v), printf('%.0f', v), replace(printf('%.2f', v), '.', ','), replace(printf('%.1f', v), '.', ','), '7', '24', '28', '30', '48', '60', '72', '90']) as s from (select event_id, cast(json_extract_string(props, '$.k') as double) as v from events) t)
    select event_id, count(distinct s) as n from n group by event_id""")
def _(fx):
    return fx["events"].select("event_id", F.size(TX.allowed_numbers(F.col("props"))).cast("bigint").alias("n"))


@query("txt4_fallback_briefing", f"select aoi_id, concat('Nell''area ', aoi_id, ' prevale il livello ', arg_max(level, (score, -cell_id)), '. Sono state esaminate ', count(*), ' celle, con questi conteggi: ', concat_ws(', ', case when count(*) filter (where level = 'High') > 0 then concat('High: ', count(*) filter (where level = 'High')) end, case when count(*) filter (where level = 'Low') > 0 then concat('Low: ', count(*) filter (where level = 'Low')) end, case when count(*) filter (where level = 'Moderate') > 0 then concat('Moderate: ', count(*) filter (where level = 'Moderate')) end, case when count(*) filter (where level = 'None') > 0 then concat('None: ', count(*) filter (where level = 'None')) end, case when count(*) filter (where level = 'VeryHigh') > 0 then concat('VeryHigh: ', count(*) filter (where level = 'VeryHigh')) end), '.{TX.READING}') as text from {STATE} s group by aoi_id")
def _(fx):
    s = state(fx).groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"), *U.class_counts(), F.max_by("level", F.struct("score", (-F.col("cell_id")).alias("c"))).alias("worst"))
    counts = TX.counts_text({n: F.col(f"n_{n.lower()}") for n in ("None", "Low", "Moderate", "High", "VeryHigh")})
    return s.select("aoi_id", TX.fallback_briefing(F.col("aoi_id"), F.col("worst"), F.col("n"), counts).alias("text"))


@query("fn15_normalised_labels", "select p_partkey, trim(regexp_replace(lower(concat('  ', p_name, '   ', p_type)), '\\s+', ' ', 'g')) as label from part")
def _(fx):
    return fx["part"].select("p_partkey", TX.collapse(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type")).alias("label"))


@query("fn16_distance_text", "select c_custkey, case when d < 100 then 'meno di 100 m' when t >= 1000 then concat(replace(printf('%.1f', round_even(d / 1000, 1)), '.', ','), ' km') else concat(t, ' m') end as txt from (select c_custkey, abs(c_acctbal) as d, cast(round_even(abs(c_acctbal) / 10, 0) * 10 as bigint) as t from customer) q")
def _(fx):
    from slopewatch.functions.scoring import distance_text

    return fx["customer"].select("c_custkey", distance_text(F.abs("c_acctbal")).alias("txt"))


@query("fn17_verdict_and_summary", "select id, case when level in ('High', 'VeryHigh') then 'warn' when level = 'Moderate' then 'watch' else 'ok' end as tone, case when m < 0.05 then 'Le precipitazioni non contano' when m < 0.2 then 'Le precipitazioni aggiungono poco.' when m < 0.5 then 'Le precipitazioni pesano' else 'Le precipitazioni fanno salire' end as rain, greatest(s, m, e, f, h) > 0.05 as driven from fx_rated")
def _(fx):
    text = TX.plain_summary({c: F.col(c) for c in "smefh"})
    t = fx["fx_rated"].withColumn("t", text)
    pick = None
    for head in ("Le precipitazioni non contano", "Le precipitazioni aggiungono poco.", "Le precipitazioni pesano", "Le precipitazioni fanno salire"):
        hit = F.col("t").contains(head)
        pick = F.when(hit, head) if pick is None else pick.when(hit, head)
    return t.select("id", TX.verdict(F.col("level"))["tone"].alias("tone"), pick.alias("rain"), F.col("t").startswith("Il peso maggiore").alias("driven"))


@query("fn18_alert_text", f"select aoi_id, printf('Livello %s nell''area %s. Celle in classe alta o più: %d. Conteggio per livello: %s. Il valore più elevato si trova nella cella %s (%.2f).', arg_max(level, (score, -cell_id)), aoi_id, count(*) filter (where {HIGH}), 'x', cast(arg_max(cell_id, (score, -cell_id)) as varchar), max(score)) as text from {STATE} s group by aoi_id")
def _(fx):
    best = F.max_by(F.struct("level", "cell_id"), F.struct("score", (-F.col("cell_id")).alias("c")))
    s = state(fx).groupBy("aoi_id").agg(F.count_if(F.col("level").isin("High", "VeryHigh")).alias("n"), best.alias("b"), F.max("score").alias("score"))
    return s.select("aoi_id", TX.alert_text(F.col("aoi_id"), F.col("b.level"), F.col("n"), F.lit("x"), F.col("b.cell_id").cast("string"), F.col("score")).alias("text"))


@query("fn19_word_count", "select doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}\\p{Pc}''-]+')) as words from documents")
def _(fx):
    return fx["documents"].select("doc_id", TX.word_count(F.col("text")).cast("bigint").alias("words"))


@query("fn20_unnest_ordinality", "select vec_id, generate_subscripts(embedding, 1) - 1 as pos, round(unnest(embedding)::double, 6) as v from embeddings")
def _(fx):
    return fx["embeddings"].select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), r6(F.col("v").cast("double"), "v"))


@query("fn21_first_of_ordered", "select c.aoi_id, arg_max(r.level, (r.score, -r.id)) as worst from fx_rated r join fx_cells c on c.cell_id = r.cell_id group by c.aoi_id")
def _(fx):
    j = fx["fx_rated"].join(fx["fx_cells"].select("cell_id", "aoi_id"), "cell_id")
    return j.groupBy("aoi_id").agg(F.max_by("level", F.struct("score", (-F.col("id")).alias("i"))).alias("worst"))


@query("fn26_tolerant_json", "select event_id, case when event_id % 5 = 0 then -1 else cast(json_extract_string(props, '$.k') as bigint) end as k, concat('{\"id\":', event_id, '}') as built from events")
def _(fx):
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{bad"), "props")).otherwise(F.col("props"))
    return fx["events"].select("event_id", F.coalesce(F.from_json(text, "k bigint")["k"], F.lit(-1)).alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("built"))


@query("fn27_hashes", "select doc_id, sha256(text) as sha, md5(text) as md from documents")
def _(fx):
    return fx["documents"].select("doc_id", F.sha2("text", 256).alias("sha"), F.md5(F.col("text").cast("binary")).alias("md"))


@query("fn28_map_projection", f"select cell_id, aoi_id, level, lon, lat from {STATE} s")
def _(fx):
    return state(fx).select("cell_id", "aoi_id", "level", "lon", "lat")


@query("fn30_pattern_search", "select p_partkey, p_type ilike '%brass%' as brass, regexp_matches(p_name, '[0-9]+$') as numbered, p_brand like 'Brand%' as branded from part")
def _(fx):
    return fx["part"].select("p_partkey", F.col("p_type").ilike("%brass%").alias("brass"), F.col("p_name").rlike("[0-9]+$").alias("numbered"), F.col("p_brand").like("Brand%").alias("branded"))


assert LATEST and sig and edges  # shared SQL fragments
