"""Queries over spatial joins, zonal statistics, grids and zones."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from slopewatch.catalog.registry import Frames, query
from slopewatch.catalog.rollups import LATEST, STATE, r6, state
from slopewatch.catalog.views import RANK_CASE
from slopewatch.functions import basic as B
from slopewatch.functions import geo as G
from slopewatch.operators import components as C
from slopewatch.operators import spatial as X
from slopewatch.operators import zonal as Z
from slopewatch.operators.relational import lookup_join, most_recent, sized_join
from slopewatch.operators.segments import nearest_segment

HALF = 0.005


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


def box_deg(x: str, y: str, lon: str = "c.lon", lat: str = "c.lat") -> str:
    return f"sqrt(pow(greatest(0, abs({x} - {lon}) - 0.005), 2) + pow(greatest(0, abs({y} - {lat}) - 0.005), 2))"


IN_DIAMOND = "abs({x} - h.cx) / h.rx + abs({y} - h.cy) / h.ry < 1"
TOUCH = """abs(h.cx - c.lon) <= 0.005 + h.rx and abs(h.cy - c.lat) <= 0.005 + h.ry
    and abs((h.cx - c.lon) / h.rx + (h.cy - c.lat) / h.ry) <= 1 + 0.005 * (1 / h.rx + 1 / h.ry)
    and abs((h.cx - c.lon) / h.rx - (h.cy - c.lat) / h.ry) <= 1 + 0.005 * (1 / h.rx + 1 / h.ry)"""
SEVERITY = "case h.hazard_class when 'P4' then 5 when 'P3' then 4 when 'P2' then 3 when 'P1' then 2 when 'AA' then 1 else 0 end"
NORM = "case h.hazard_class when 'AA' then 0.2 when 'P1' then 0.4 when 'P2' then 0.6 when 'P3' then 0.8 when 'P4' then 1.0 end"


def rings(fx: Frames):
    cx, cy, rx, ry = (F.col(c) for c in ("cx", "cy", "rx", "ry"))
    return fx["fx_hazard"].select(
        "geom_id", F.array(cx - rx, cx, cx + rx, cx).alias("xs"), F.array(cy, cy - ry, cy, cy + ry).alias("ys")
    )


def edges(fx: Frames):
    return X.ring_edges(rings(fx))


def inventory_points(fx: Frames):
    return fx["fx_inventory"].select(F.col("id").alias("point_id"), "x", "y")


def severity():
    return F.coalesce(B.lookup({"AA": 1, "P1": 2, "P2": 3, "P3": 4, "P4": 5}, "hazard_class"), F.lit(0))


@query("join5_points_in_polygons", f"select i.id as point_id, h.geom_id from fx_inventory i join fx_hazard h on {IN_DIAMOND.format(x='i.x', y='i.y')}")
def _(fx):
    return X.points_in_polygons(inventory_points(fx), edges(fx))


@query("join6_first_containing", f"select i.id as point_id, arg_min(h.label, h.geom_id) as name from fx_inventory i join fx_hazard h on {IN_DIAMOND.format(x='i.x', y='i.y')} group by i.id")
def _(fx):
    names = fx["fx_hazard"].select("geom_id", F.col("label").alias("name"))
    return X.first_containing(X.points_in_polygons(inventory_points(fx), edges(fx)), names)


@query("join7_hazard_at_point", f"select point_id, hazard_class from (select i.id as point_id, h.hazard_class, row_number() over (partition by i.id order by {SEVERITY} desc, h.geom_id) as rn from fx_inventory i join fx_hazard h on {IN_DIAMOND.format(x='i.x', y='i.y')}) t where rn = 1")
def _(fx):
    hits = X.points_in_polygons(inventory_points(fx), edges(fx))
    return X.most_severe(hits, fx["fx_hazard"].select("geom_id", "hazard_class"), severity()).select("point_id", "hazard_class")


def touching(fx: Frames):
    return X.polygons_touching_cells(fx["fx_cells"], edges(fx))


@query("join8_worst_hazard", f"select c.cell_id, max({NORM})::double as norm from fx_cells c left join fx_hazard h on {TOUCH} group by c.cell_id")
def _(fx):
    from slopewatch.functions.scoring import hazard_norm

    worst = sized_join(touching(fx), fx["fx_hazard"].select("geom_id", "hazard_class"), "geom_id").groupBy("cell_id").agg(F.max(hazard_norm(F.col("hazard_class"))).alias("norm"))
    return fx["fx_cells"].select("cell_id").join(worst, "cell_id", "left")


@query("join9_class_of_worst", f"select c.cell_id, max({NORM})::double as norm, arg_max(h.hazard_class, ({NORM}, -h.geom_id)) filter (where {NORM} is not null) as class from fx_cells c left join fx_hazard h on {TOUCH} group by c.cell_id")
def _(fx):
    from slopewatch.functions.scoring import hazard_norm

    known = sized_join(touching(fx), fx["fx_hazard"].select("geom_id", "hazard_class"), "geom_id").withColumn("norm", hazard_norm(F.col("hazard_class"))).filter(F.col("norm").isNotNull())
    worst = known.groupBy("cell_id").agg(F.max("norm").alias("norm"), F.max_by("hazard_class", F.struct("norm", -F.col("geom_id"))).alias("class"))
    return fx["fx_cells"].select("cell_id").join(worst, "cell_id", "left")


R_DEG = 500.0 / 111_320.0


@query("join10_count_within", f"select c.cell_id, count(i.id) as n from fx_cells c left join fx_inventory i on {box_deg('i.x', 'i.y')} <= {R_DEG!r} group by c.cell_id")
def _(fx):
    return X.count_within(fx["fx_cells"], fx["fx_inventory"].select("x", "y"), R_DEG, HALF)


@query("join11_density_geodesic", f"select c.cell_id, round(least(count(*) / 3.0, 1.0), 6) as density from fx_cells c join fx_inventory i on {hav('c.lon', 'c.lat', 'i.x', 'i.y')} <= 500 group by c.cell_id")
def _(fx):
    near = X.count_within_m(fx["fx_cells"], fx["fx_inventory"].select("x", "y"), 500.0)
    return near.select("cell_id", r6(F.least(F.col("n") / 3.0, F.lit(1.0)), "density"))


@query("join12_nearest_distance", f"select c.cell_id, round(least(coalesce(min({hav('c.lon', 'c.lat', 'i.x', 'i.y')}), 50000), 50000), 3) as dist_m from fx_cells c left join fx_inventory i on true group by c.cell_id")
def _(fx):
    return X.nearest_feature(fx["fx_cells"], fx["fx_inventory"].select("x", "y")).withColumn("dist_m", F.round("dist_m", 3))


@query("join13_nearest_road", f"select cell_id, round(least(d, 50000), 3) as dist_m, case when d <= 50000 then class end as class from (select c.cell_id, n.class, {hav('c.lon', 'c.lat', 'n.x', 'n.y')} as d, row_number() over (partition by c.cell_id order by {hav('c.lon', 'c.lat', 'n.x', 'n.y')}, n.class) as rn from fx_cells c join fx_network n on n.kind = 'road') t where rn = 1")
def _(fx):
    roads = fx["fx_network"].filter(F.col("kind") == "road").select("x", "y", "class")
    return X.nearest_feature(fx["fx_cells"], roads, keep="class").withColumn("dist_m", F.round("dist_m", 3))


T_PAR = "greatest(0, least(1, ((c.lon - f.x1) * (f.x2 - f.x1) + (c.lat - f.y1) * (f.y2 - f.y1)) / (pow(f.x2 - f.x1, 2) + pow(f.y2 - f.y1, 2))))"


@query("join14_nearest_fault", f"""select c.cell_id, round(least(coalesce(min({hav('c.lon', 'c.lat', f'(f.x1 + {T_PAR} * (f.x2 - f.x1))', f'(f.y1 + {T_PAR} * (f.y2 - f.y1))')}), 50000), 50000), 3) as dist_m
    from fx_cells c left join fx_faults f on least(f.x1, f.x2) <= c.lon + 0.5 and greatest(f.x1, f.x2) >= c.lon - 0.5 and least(f.y1, f.y2) <= c.lat + 0.5 and greatest(f.y1, f.y2) >= c.lat - 0.5 group by c.cell_id""")
def _(fx):
    return nearest_segment(fx["fx_cells"], fx["fx_faults"]).withColumn("dist_m", F.round("dist_m", 3))


@query("join16_near_urban", f"select c.cell_id, exists (select 1 from fx_cells u join fx_static s on s.cell_id = u.cell_id where s.landuse_code like '11%' and sqrt(pow(greatest(0, abs(u.lon - c.lon) - 0.01), 2) + pow(greatest(0, abs(u.lat - c.lat) - 0.01), 2)) <= 0.0215) as near_urban from fx_cells c")
def _(fx):
    # square to square: the reach from the centre of one to the doubled square of the other
    urban = fx["fx_cells"].join(fx["fx_static"].filter(F.col("landuse_code").startswith("11")).select("cell_id"), "cell_id").select(F.col("lon").alias("x"), F.col("lat").alias("y"))
    near = X.count_within(fx["fx_cells"], urban, 0.0215, 2 * HALF)
    return near.select("cell_id", (F.col("n") > 0).alias("near_urban"))


def day(text: str):
    return F.lit(text).cast("timestamp_ntz")


IN_CELL = "e.x >= c.lon - 0.005 and e.x < c.lon + 0.005 and e.y >= c.lat - 0.005 and e.y < c.lat + 0.005"


@query("join18_events_in_area", f"select c.aoi_id, count(*) as n from fx_truth e join fx_cells c on {IN_CELL} where e.event_time > timestamp '1998-01-01' and e.event_time <= timestamp '1999-01-01' group by c.aoi_id")
def _(fx):
    events = fx["fx_truth"].filter((F.col("event_time") > day("1998-01-01")) & (F.col("event_time") <= day("1999-01-01")))
    # square cells: the cell of a point is a closed form, so the join is an equi-join
    placed = events.withColumns({"col_idx": F.floor((F.col("x") - 9.995) / 0.01).cast("int"), "row_idx": F.floor((F.col("y") - 37.995) / 0.01).cast("int")})
    cells = fx["fx_cells"].select("row_idx", "col_idx", "aoi_id")
    return placed.join(cells, ["row_idx", "col_idx"]).groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"))


# numbers only: latest cells at High or above with their area
ZONED = """(select l.cell_id, n.n_regionkey as aoi, c.lon, c.lat, l.score from (select o_custkey as cell_id, o_totalprice / cast(500009 as double) as score,
    row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) l join fx_cells c on c.cell_id = l.cell_id join nation n on n.n_nationkey = c.istat_code where l.rn = 1 and l.score >= 0.55)"""
ZONES = f"""z as materialized (select *, cast(round((lon - 10) / 0.01) as int) as cx, cast(round((lat - 38) / 0.01) as int) as cy from {ZONED} q),
    e as materialized (select a.cell_id as a, b.cell_id as b from z a join z b on a.aoi = b.aoi and (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 4),
    r as (select a as cell_id, a as root from e where a = b union select e.b, r.root from r join e on e.a = r.cell_id),
    m as materialized (select cell_id, min(root) as zone from r group by cell_id)"""


def high_zones(fx: Frames):
    cells = state(fx).filter(B.at_least("level", "High")).select("cell_id", "aoi_id", "lon", "lat", "score", "level")
    return C.zones(cells, 0.02)


@query("agg35_contiguous_zones", f"with recursive {ZONES} select z.cell_id, concat('aoi-', z.aoi) as aoi_id, m.zone from z join m on m.cell_id = z.cell_id")
def _(fx):
    return high_zones(fx).select("cell_id", "aoi_id", "zone")


@query("agg36_zone_summary", f"""with recursive {ZONES} select concat('aoi-', z.aoi) as aoi_id, m.zone, count(*) as n_cells, round(max(z.score), 6) as max_score, arg_min(z.cell_id, (-z.score, z.cell_id)) as dominant_cell,
    round(min(z.lon) - 0.005, 6) as minx, round(max(z.lat) + 0.005, 6) as maxy from z join m on m.cell_id = z.cell_id group by z.aoi, m.zone""")
def _(fx):
    s = C.zone_summary(high_zones(fx))
    return s.select("aoi_id", "zone", "n_cells", r6(F.col("max_score"), "max_score"), "dominant_cell", r6(F.col("minx"), "minx"), r6(F.col("maxy"), "maxy"))


@query("top9_zone_cap", f"with recursive {ZONES} select m.zone, round(max(z.score), 6) as max_score from z join m on m.cell_id = z.cell_id group by m.zone order by max(z.score) desc, arg_min(z.cell_id, (-z.score, z.cell_id)) limit 50")
def _(fx):
    s = C.zone_summary(high_zones(fx))
    return s.orderBy(F.desc("max_score"), "dominant_cell").limit(50).select("zone", r6(F.col("max_score"), "max_score"))


def window_events(fx: Frames):
    events = fx["fx_truth"].filter((F.col("event_time") > day("2000-06-01")) & (F.col("event_time") <= day("2000-09-01")))
    return events.select("event_id", "event_time", F.col("x").alias("lon"), F.col("y").alias("lat"))


def verified(fx: Frames, members, radius_m: float):
    """Verification of zones given as (cell_id, zone, lon, lat): whether anything is near is all that is asked of either side."""
    from slopewatch.operators.evaluation import zone_verification

    events, at = window_events(fx), lambda t: t.select(F.col("lon").alias("x"), F.col("lat").alias("y"))
    hit = X.count_within_m(members, at(events), radius_m).join(members, "cell_id").select("zone")
    matched = X.count_within_m(events, at(members), radius_m, "event_id")
    lead = events.select("event_id", B.hours_between("event_time", day("2000-06-01")).alias("lead_h"))
    out = zone_verification(hit, matched, members, lead)
    return out.withColumns({"pod": F.round("pod", 6), "far": F.round("far", 6), "mean_lead_h": F.round("mean_lead_h", 4)})


@query("join17_zone_events", f"""select s.istat_code as zone, e.event_id, round(min({hav('s.lon', 's.lat', 'e.x', 'e.y')}), 3) as dist_m from {STATE} s join fx_truth e on {hav('s.lon', 's.lat', 'e.x', 'e.y')} <= 2000
    where s.score >= 0.55 and e.event_time > timestamp '2000-06-01' and e.event_time <= timestamp '2000-09-01' group by s.istat_code, e.event_id""")
def _(fx):
    zoned = state(fx).filter(B.at_least("level", "High")).select(F.col("istat_code").alias("zone"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return X.nearest_group_within_m(window_events(fx), zoned, "zone", 2000.0, "event_id").select("zone", "event_id", F.round("dist", 3).alias("dist_m"))


MUNI_ZONES = f"(select cell_id, istat_code as zone, lon, lat from {STATE} s where {RANK_CASE} = 4)"


VERIFIED = f"""k as (select z.zone, e.event_id from z join fx_truth e on {hav('z.lon', 'z.lat', 'e.x', 'e.y')} <= {{radius}} where e.event_time > timestamp '2000-06-01' and e.event_time <= timestamp '2000-09-01' group by z.zone, e.event_id),
    zs as (select d.zone, h.zone is not null as hit from (select distinct zone from z) d left join (select distinct zone from k) h on h.zone = d.zone),
    ev as (select e.event_id, (epoch_us(event_time) - epoch_us(timestamp '2000-06-01')) / 3.6e9 as lead_h, h.event_id is not null as hit from fx_truth e left join (select distinct event_id from k) h on h.event_id = e.event_id
           where event_time > timestamp '2000-06-01' and event_time <= timestamp '2000-09-01'),
    a as (select count(*) as n_zones, count(*) filter (where not hit) as false_alarm_zones from zs), b as (select count(*) as n_events, count(*) filter (where hit) as matched, count(*) filter (where not hit) as missed, avg(lead_h) filter (where hit) as lead from ev)
    select n_zones, false_alarm_zones, n_events, matched, missed, round(matched / n_events, 6) as pod, round(false_alarm_zones / n_zones, 6) as far, round(lead, 4) as mean_lead_h from a, b"""


@query("agg38_zone_verification", f"with z as (select * from {MUNI_ZONES} q), {VERIFIED.format(radius=900)}")
def _(fx):
    return verified(fx, state(fx).filter(F.col("level") == "VeryHigh").select("cell_id", F.col("istat_code").alias("zone"), "lon", "lat"), 900.0)


@query("pip8_report_verification", f"with recursive {ZONES.replace('z as materialized', 'zc as materialized').replace('from z a join z b', 'from zc a join zc b')}, z as (select zc.cell_id, m.zone, zc.lon, zc.lat from zc join m on m.cell_id = zc.cell_id), {VERIFIED.format(radius=2000)}")
def _(fx):
    return verified(fx, high_zones(fx).select("cell_id", "zone", "lon", "lat"), 2000.0)


# --- overlay and zonal statistics ---------------------------------------------------------
def prim(y: str) -> str:
    return f"(case when {y} <= 0 then 0 when {y} <= 0.01 then {y} * {y} / 2 else 0.01 * {y} - 0.00005 end)"


OVERLAY = f"""e as (select geom_id, label, unnest([cx - rx, cx, cx + rx, cx]) as x1, unnest([cy, cy - ry, cy, cy + ry]) as y1, unnest([cx, cx + rx, cx, cx - rx]) as x2, unnest([cy - ry, cy, cy + ry, cy]) as y2 from fx_hazard),
    p as (select c.cell_id, e.geom_id, e.label, c.lon, c.lat, x1, y1, x2, y2, greatest(least(x1, x2), c.lon - 0.005) as a, least(greatest(x1, x2), c.lon + 0.005) as z from fx_cells c join fx_hazard h on {TOUCH} join e on e.geom_id = h.geom_id),
    q as (select *, y1 + (a - x1) / (x2 - x1) * (y2 - y1) - (lat - 0.005) as ya, y1 + (z - x1) / (x2 - x1) * (y2 - y1) - (lat - 0.005) as yz from p where z > a),
    g as (select cell_id, geom_id, label, abs(sum((case when abs(yz - ya) > 1e-12 then ({prim('yz')} - {prim('ya')}) / (yz - ya) else greatest(0, least(0.01, (ya + yz) / 2)) end) * (z - a) * sign(x2 - x1))) as area from q group by cell_id, geom_id, label)"""


@query("join27_udf3_overlap_area", f"with {OVERLAY} select cell_id, geom_id, round(area * 1e8, 3) as area from g where area > 1e-12")
def _(fx):
    areas = Z.overlap_areas(fx["fx_cells"], edges(fx))
    return areas.filter(F.col("area") > 1e-12).select("cell_id", "geom_id", F.round(F.col("area") * 1e8, 3).alias("area"))


@query("join27_dominant_lithology", f"with {OVERLAY} select cell_id, label from (select *, row_number() over (partition by cell_id order by round(area, 12) desc, label) as rn from g where area > 1e-12) t where rn = 1")
def _(fx):
    areas = Z.overlap_areas(fx["fx_cells"], edges(fx)).filter(F.col("area") > 1e-12)
    return Z.dominant_label(areas, fx["fx_hazard"].select("geom_id", "label"))


@query("agg11_scatterers", """select c.cell_id, count(e.event_id) as n, round(quantile_cont(e.event_id % 100, 0.5), 4) as velocity, round(quantile_cont(case when e.event_id % 3 = 0 then null else e.event_id % 10 end, 0.5), 4) as accel, coalesce(epoch_us(min(e.event_time)), -1) as first_us, coalesce(epoch_us(max(e.event_time)), -1) as last_us
    from fx_cells c left join fx_truth e on e.x >= c.lon - 0.005 and e.x < c.lon + 0.005 and e.y >= c.lat - 0.005 and e.y < c.lat + 0.005 group by c.cell_id""")
def _(fx):
    pts = fx["fx_truth"].withColumns({"col_idx": F.floor((F.col("x") - 9.995) / 0.01).cast("int"), "row_idx": F.floor((F.col("y") - 37.995) / 0.01).cast("int")})
    located = pts.join(fx["fx_cells"].select(F.col("cell_id").alias("_c"), "row_idx", "col_idx"), ["row_idx", "col_idx"]).select(
        F.col("_c").alias("cell_id"), (F.col("event_id") % 100).cast("double").alias("velocity_mmy"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 10).cast("double").alias("accel_mmy2"),
        F.col("event_time").alias("period_start"), F.col("event_time").alias("period_end"),
    )
    out = Z.scatterer_stats(fx["fx_cells"], located)
    return out.select(
        "cell_id", F.col("scatterer_count").alias("n"), F.round("velocity_mmy", 4).alias("velocity"), F.round("accel_mmy2", 4).alias("accel"),
        F.coalesce(B.epoch_us("period_start"), F.lit(-1)).alias("first_us"), F.coalesce(B.epoch_us("period_end"), F.lit(-1)).alias("last_us"),
    )


@query("agg12_majority_class", "select cell_id, cast(code as varchar) as majority, pixels from (select cell_id, code, row_number() over (partition by cell_id order by count(*) desc, code) as rn, cast(sum(count(*)) over (partition by cell_id) as bigint) as pixels from fx_pixels where code <> 0 group by cell_id, code) t where rn = 1")
def _(fx):
    return Z.majority_class(fx["fx_pixels"], nodata=0)


GRAD = "case when {i} = 0 then ({nxt} - {v}) when {i} = 4 then ({v} - {prv}) else ({nxt} - {prv}) / 2 end / 100"
TERRAIN = f"""a as (select *, {GRAD.format(i='col', v='z', nxt='lead(z) over r', prv='lag(z) over r')} as dx, -({GRAD.format(i='row', v='z', nxt='lead(z) over c', prv='lag(z) over c')}) as dy from fx_pixels window r as (partition by cell_id, row order by col), c as (partition by cell_id, col order by row)),
    b as (select *, {GRAD.format(i='col', v='dx', nxt='lead(dx) over r', prv='lag(dx) over r')} + -({GRAD.format(i='row', v='dy', nxt='lead(dy) over c', prv='lag(dy) over c')}) as curv, degrees(atan(sqrt(dx * dx + dy * dy))) as slope,
        case when abs(dx) < 1e-9 and abs(dy) < 1e-9 then -1 else degrees(atan2(dx, dy)) + 360 - 360 * floor((degrees(atan2(dx, dy)) + 360) / 360) end as aspect from a window r as (partition by cell_id, row order by col), c as (partition by cell_id, col order by row))"""


@query("agg13_terrain_stats", f"with {TERRAIN} select cell_id, round(avg(z), 5) as elevation_m, round(avg(slope), 5) as slope_deg, round(avg(curv) * 1000, 5) as curvature, round(quantile_cont(aspect, 0.5) filter (where aspect >= 0), 4) as aspect_deg, count(z) as pixel_count from b group by cell_id")
def _(fx):
    s = Z.terrain_stats(fx["fx_pixels"], 100.0)
    return s.select(
        "cell_id", F.round("elevation_m", 5).alias("elevation_m"), F.round("slope_deg", 5).alias("slope_deg"), F.round(F.col("curvature") * 1000, 5).alias("curvature"),
        F.round("aspect_deg", 4).alias("aspect_deg"), "pixel_count",
    )


@query("fn3_terrain_pixels", f"with {TERRAIN} select cell_id, cast(row as int) as r, cast(col as int) as c, round(slope, 5) as slope, round(aspect, 4) as aspect, round(curv * 1000, 5) as curvature from b")
def _(fx):
    t = Z.terrain(fx["fx_pixels"], 100.0)
    return t.select("cell_id", F.col("row").cast("int").alias("r"), F.col("col").cast("int").alias("c"), F.round("slope", 5).alias("slope"), F.round("aspect", 4).alias("aspect"), F.round(F.col("curvature") * 1000, 5).alias("curvature"))


@query("prj21_zonal_outcome", "select cell_id, count(*) as n from fx_pixels where code > 10 group by cell_id")
def _(fx):
    return fx["fx_pixels"].filter(F.col("code") > 10).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


def laea(lon: str, lat: str) -> tuple[str, str]:
    e2, e = G._E2, math.sqrt(G._E2)
    s = f"sin(radians({lat}))"
    q = f"({1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}))"
    beta = f"asin({q} / {G._QP!r})"
    sb, cb = math.sin(G._B0), math.cos(G._B0)
    d = f"(radians({lon}) - {G._LON0!r})"
    b = f"({G._RQ!r} * sqrt(2 / (1 + {sb!r} * sin({beta}) + {cb!r} * cos({beta}) * cos({d}))))"
    x = f"({G._FE!r} + {b} * {G._D!r} * cos({beta}) * sin({d}))"
    y = f"({G._FN!r} + {b} / {G._D!r} * ({cb!r} * sin({beta}) - {sb!r} * cos({beta}) * cos({d})))"
    return x, y


_LX, _LY = laea("lon", "lat")


@query("fn8_metric_grid", f"select cell_id, round({_LX}, 3) as x, round({_LY}, 3) as y from fx_cells")
def _(fx):
    x, y = G.to_3035("lon", "lat")
    return fx["fx_cells"].select("cell_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("fn8_round_trip", "select cell_id, round(lon, 7) as lon, round(lat, 7) as lat from fx_cells")
def _(fx):
    x, y = G.to_3035("lon", "lat")
    lon, lat = G.from_3035("_x", "_y")
    return fx["fx_cells"].withColumns({"_x": x, "_y": y}).select("cell_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


_V = [("cx - rx", "cy"), ("cx", "cy - ry"), ("cx + rx", "cy"), ("cx", "cy + ry")]
_P = [laea(a, b) for a, b in _V]
AREA = f"v as (select geom_id, hazard_class, " + ", ".join(f"{x} as x{i}, {y} as y{i}" for i, (x, y) in enumerate(_P)) + " from fx_hazard), s as (select *, abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2 as a from v)"


@query("agg31_area_per_class", f"with {AREA} select hazard_class, count(*) as n, round(sum(a) / 1e6, 4) as area_km2 from s group by hazard_class")
def _(fx):
    areas = X.metric_areas(edges(fx))
    named = areas.join(fx["fx_hazard"].select("geom_id", "hazard_class"), "geom_id")
    return named.groupBy("hazard_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area_m2") / 1e6, 4).alias("area_km2"))


BOXES = "(select aoi_id, min(lon) - 0.005 as x0, min(lat) - 0.005 as y0, max(lon) + 0.005 as x1, max(lat) + 0.005 as y1 from fx_cells group by aoi_id)"


@query("agg32_radar_peak", f"select b.aoi_id, round(coalesce(max(r.mm_h), 0), 3) as peak, count(*) filter (where r.mm_h >= 30) as hot_pixels from {BOXES} b left join fx_radar r on r.mm_h > -9999 and r.x between b.x0 and b.x1 and r.y between b.y0 and b.y1 group by b.aoi_id")
def _(fx):
    from slopewatch.sources.features import radar_pixels

    boxes = area_boxes(fx)
    return radar_peaks(radar_pixels(fx["fx_radar"]), boxes)


def area_boxes(fx: Frames):
    return fx["fx_cells"].groupBy("aoi_id").agg(
        (F.min("lon") - HALF).alias("minx"), (F.min("lat") - HALF).alias("miny"), (F.max("lon") + HALF).alias("maxx"), (F.max("lat") + HALF).alias("maxy")
    )


def radar_peaks(pixels, boxes, threshold: float = 30.0):
    """Peak and hot pixels per area box: pixels meet boxes through coarse tiles."""
    px = pixels.groupBy("x", "y").agg(F.max("mm_h").alias("mm_h"), F.count_if(F.col("mm_h") >= threshold).alias("hot"))
    hit = X.box_candidates(px, boxes, 0.5, "aoi_id").groupBy("aoi_id").agg(F.max("mm_h").alias("peak"), F.sum("hot").alias("hot_pixels"))
    out = lookup_join(boxes.select("aoi_id"), hit, "aoi_id")
    return out.select("aoi_id", F.round(F.coalesce("peak", F.lit(0.0)), 3).alias("peak"), F.coalesce("hot_pixels", F.lit(0)).cast("bigint").alias("hot_pixels"))


# --- geometry functions ---------------------------------------------------------------------
@query("fn2_haversine", f"select cell_id, round({hav('10.0', '38.0', 'lon', 'lat')}, 3) as m from fx_cells")
def _(fx):
    return fx["fx_cells"].select("cell_id", F.round(G.haversine_m(F.lit(10.0), F.lit(38.0), F.col("lon"), F.col("lat")), 3).alias("m"))


@query("fn7_extent", "select aoi_id, round(min(lon), 6) as minx, round(min(lat), 6) as miny, round(max(lon), 6) as maxx, round(max(lat), 6) as maxy, round((min(lon) + max(lon)) / 2 + 1e-9, 6) as cx from fx_cells group by aoi_id")
def _(fx):
    return fx["fx_cells"].groupBy("aoi_id").agg(
        r6(F.min("lon"), "minx"), r6(F.min("lat"), "miny"), r6(F.max("lon"), "maxx"), r6(F.max("lat"), "maxy"), r6((F.min("lon") + F.max("lon")) / 2 + 1e-9, "cx")
    )


@query("fn10_coordinate_label", "select cell_id, printf('%.4f° %s, %.4f° %s', abs(lat), case when lat >= 0 then 'N' else 'S' end, abs(lon), case when lon >= 0 then 'E' else 'W' end) as label from fx_cells")
def _(fx):
    return fx["fx_cells"].select("cell_id", G.coordinate_label("lat", "lon").alias("label"))


@query("fn5_rain_nodes", f"select aoi_id, j * nx + i as node_idx, round(x0 + i * 0.1, 6) as lon, round(y0 + j * 0.1, 6) as lat from (select aoi_id, x0, y0, cast(floor((x1 - x0 + 1e-9) / 0.1) as bigint) + 1 as nx, cast(floor((y1 - y0 + 1e-9) / 0.1) as bigint) + 1 as ny from {BOXES} b) b, range(2000) a(i), range(2000) c(j) where i < nx and j < ny")
def _(fx):
    from slopewatch.sources.weather import node_table

    return node_table(area_boxes(fx), 0.1).select("aoi_id", "node_idx", r6(F.col("lon"), "lon"), r6(F.col("lat"), "lat"))


@query("fn4_metric_cells", f"""with p as (select aoi_id, {_LX} as x, {_LY} as y from fx_cells), b as (select aoi_id, min(x) as x0, min(y) as y0, ceil((max(x) - min(x)) / 1000)::bigint as nc, ceil((max(y) - min(y)) / 1000)::bigint as nr from p group by aoi_id)
    select aoi_id, nr * nc as candidates, nr as n_rows, nc as n_cols from b""")
def _(fx):
    from slopewatch.sources.features import grid_candidates

    x, y = G.to_3035("lon", "lat")
    boxes = fx["fx_cells"].select("aoi_id", x.alias("x"), y.alias("y")).groupBy("aoi_id").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    cells = grid_candidates(boxes, 1000.0)
    return cells.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("candidates"), (F.max("row_idx") + 1).cast("bigint").alias("n_rows"), (F.max("col_idx") + 1).cast("bigint").alias("n_cols"))


@query("fn9_subdivision", f"""with {OVERLAY.split('),' + chr(10) + '    p as')[0]}) select geom_id, s as slab, count(*) as n_edges from (select e.geom_id, unnest(generate_series(cast(floor(least(y1, y2) / 0.02) as bigint), cast(floor(greatest(y1, y2) / 0.02) as bigint))) as s from e) t group by geom_id, s""")
def _(fx):
    return X.edges_by_slab(edges(fx), 0.02).groupBy("geom_id", "slab").agg(F.count(F.lit(1)).alias("n_edges"))


@query("join29_recent_fire", f"select c.cell_id, cast(max(d) as varchar) as last_fire from fx_cells c join (select *, date '2020-01-01' + cast(geom_id % 900 as int) as d from fx_hazard) h on {TOUCH} group by c.cell_id")
def _(fx):
    fires = fx["fx_hazard"].select("geom_id", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("geom_id") % 900).cast("int")).alias("d"))
    return most_recent(sized_join(touching(fx), fires, "geom_id"), ["cell_id"], "d").select("cell_id", F.col("d").cast("string").alias("last_fire"))


assert LATEST  # re-exported for the pipelines
