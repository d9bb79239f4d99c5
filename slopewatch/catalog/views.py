"""Stand-in views: the shapes of a hazard store, derived from the given tables.

Every text runs in Spark SQL and in ANSI SQL engines (only the name of the row
generator differs, see ``SPARK_NAMES``). Cells sit on a
square lattice of 0.01 degrees that grows evenly with the customer table: row
and column are the odd and even bits of the key.
"""

from __future__ import annotations

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# row generator: SQL text -> Spark
SPARK_NAMES = {"unnest(generate_series(": "explode(sequence("}


def _bits(key: str, offset: int) -> str:
    """Every second bit of a 64-bit key, packed; bit operations need no overflow checks."""
    out = f"(({key} >> {offset}) & 1)"
    for i in range(1, 31):
        out = f"({out} | ((({key} >> {2 * i + offset}) & 1) << {i}))"
    return out


def lattice(key: str) -> tuple[str, str]:
    """(column, row) of a key on the square lattice."""
    return _bits(key, 0), _bits(key, 1)


_COL, _ROW = lattice("c_custkey")
_PCOL, _PROW = lattice("p_partkey")
_SCOL, _SROW = lattice("s_suppkey * 13")
_VCOL, _VROW = lattice("vec_id * 3")

LEVEL_CASE = (
    "case when score < cast(0.15 as double) then 'None' when score < cast(0.35 as double) then 'Low' "
    "when score < cast(0.55 as double) then 'Moderate' when score < cast(0.75 as double) then 'High' else 'VeryHigh' end"
)
RANK_CASE = "case level when 'None' then 0 when 'Low' then 1 when 'Moderate' then 2 when 'High' then 3 else 4 end"

VIEWS: dict[str, str] = {
    "fx_aoi": "select concat('aoi-', r_regionkey) as aoi_id, r_name as name from region",
    "fx_comuni": "select n_nationkey as istat_code, n_name as name, concat('aoi-', n_regionkey) as aoi_id from nation",
    "fx_cells": f"""
        select c_custkey as cell_id, n_nationkey as istat_code, concat('aoi-', n_regionkey) as aoi_id,
               cast({_ROW} as int) as row_idx, cast({_COL} as int) as col_idx,
               cast(10 as double) + cast(0.01 as double) * {_COL} as lon,
               cast(38 as double) + cast(0.01 as double) * {_ROW} as lat
        from customer join nation on n_nationkey = c_nationkey""",
    "fx_static": """
        select c_custkey as cell_id,
               cast(c_custkey * 7 % 460 as double) / cast(10 as double) as slope_deg,
               cast(c_custkey % 11 as double) as iffi_density_500,
               case c_custkey % 6 when 0 then null when 1 then cast(0.2 as double) when 2 then cast(0.4 as double)
                    when 3 then cast(0.6 as double) when 4 then cast(0.8 as double) else cast(1 as double) end as pai_class_norm,
               case c_custkey % 4 when 0 then cast(0.85 as double) when 1 then cast(0.5 as double) when 2 then cast(0.3 as double) end as litho_weight,
               case when c_custkey % 3 = 0 then null else cast(c_custkey % 17 as double) / cast(17 as double) end as susc_ispra,
               case when c_custkey % 5 = 1 then null else cast(c_custkey % 5 as double) / cast(4 as double) end as flood_hazard_norm,
               case c_mktsegment when 'BUILDING' then '112' when 'MACHINERY' then '121' else '311' end as landuse_code,
               c_custkey % 9 = 0 as near_urban, c_custkey % 7 = 0 as near_infra,
               abs(c_acctbal) as distance_to_road_m,
               case when c_custkey % 5 = 0 then null else abs(c_acctbal) / cast(2 as double) end as distance_to_rail_m,
               case c_custkey % 3 when 0 then 'motorway' when 1 then 'primary' end as nearest_road_class
        from customer""",
    "fx_assess": """
        select o_orderkey as id, o_custkey as cell_id, o_orderdate as computed_at,
               case when o_orderpriority = '1-URGENT' then '+48h' else '24h' end as horizon,
               case when o_orderpriority = '1-URGENT' then 'v1-forecast+48h' else 'v1' end as pipeline_version,
               o_totalprice / cast(500009 as double) as score,
               cast(o_orderkey % 101 as double) / cast(100 as double) as s,
               cast(o_orderkey * 3 % 101 as double) / cast(100 as double) as m,
               cast(o_orderkey * 7 % 101 as double) / cast(100 as double) as e,
               cast(o_orderkey * 11 % 101 as double) / cast(100 as double) as f,
               cast(o_orderkey * 13 % 101 as double) / cast(100 as double) as h,
               cast(o_orderkey * 17 % 101 as double) / cast(100 as double) as k,
               o_orderkey % 97 = 0 as hard_escalation
        from orders""",
    "fx_rated": f"select *, {LEVEL_CASE} as level from fx_assess",
    "fx_runs": """
        select l_orderkey * 8 + l_linenumber as id, o_custkey as cell_id, max(l_shipdate) as computed_at,
               round(max(l_quantity) / cast(50 as double), 6) as probability
        from lineitem join orders on o_orderkey = l_orderkey
        group by l_orderkey, l_linenumber, o_custkey""",
    "fx_obs": """
        select event_id as id, user_id as device_id, user_id % 10 as site_id,
               case event_type when 'view' then 'rainfall' when 'click' then 'pore_pressure' when 'purchase' then 'soil_moisture'
                    when 'signup' then 'displacement' else 'velocity' end as observed_property,
               ts as phenomenon_time, value as result_value
        from events""",
    "fx_rain": """
        select user_id as series_id, date_trunc('hour', ts) as ts,
               sum(case when event_type in ('view', 'click') then value / cast(10.7 as double) else cast(0 as double) end) as mm
        from events group by user_id, date_trunc('hour', ts)""",
    "fx_bundle": """
        select o_orderkey as id, s.cell_id, o_orderdate as valuation_time,
               s.susc_ispra, s.iffi_density_500, s.slope_deg, s.pai_class_norm, s.litho_weight, s.flood_hazard_norm,
               cast(1 + o_orderkey % 72 as double) as event_hours,
               case when o_orderkey % 6 = 0 then null else o_totalprice / cast(2000 as double) end as event_mm,
               case when o_orderkey % 7 = 0 then null else cast(o_orderkey * 13 % 300 as double) end as api_30_mm,
               case when o_orderkey % 4 = 0 then cast(o_orderkey % 120 as double) end as api_baseline_mm,
               case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 50 as double) / cast(100 as double) end as soil_moisture,
               case when o_orderkey % 4 = 1 then null else cast(o_orderkey % 20 as double) / cast(100 as double) end as snow_depth_m,
               cast(o_orderkey % 61 as double) as rain_24h_mm,
               cast(o_orderkey % 30 as double) / cast(100 as double) - cast(0.05 as double) as pga_g,
               cast(o_orderkey % 70 as double) / cast(10 as double) as magnitude,
               cast(o_orderkey % 90 as double) / cast(10 as double) - cast(0.5 as double) as age_days,
               case when o_orderkey % 3 = 0 then null else cast(o_orderkey % 30 as double) end as months_since_fire,
               case when o_orderkey % 8 = 3 then null else cast(o_orderkey % 200 as double) end as flood_rain_72h_mm,
               case when o_orderkey % 8 = 4 then null else cast(o_orderkey % 50 as double) / cast(10 as double) end as discharge_ratio,
               case when o_orderkey % 8 = 5 then null else cast(o_orderkey % 13 as double) / cast(10 as double) end as coastal_surge,
               case when o_orderkey % 9 = 2 then cast(o_orderkey % 4 as double) end as sensor_rainfall_mm,
               case when o_orderkey % 9 = 4 then cast(o_orderkey % 80 as double) end as sensor_pore_kpa,
               case when o_orderkey % 9 = 6 then cast(o_orderkey % 10 as double) / cast(10 as double) end as sensor_soil,
               case when o_orderkey % 10 in (1, 2) then cast(o_orderkey % 12 as double) end as velocity_mmd,
               case when o_orderkey % 10 in (2, 3) then cast(o_orderkey % 40 as double) / cast(10 as double) end as acceleration_mmd2,
               case when o_orderkey % 20 = 2 then cast(o_orderkey % 50 as double) / cast(100 as double) end as inverse_velocity,
               case o_orderkey % 5 when 0 then 'southern_italy' when 1 then 'central_italy' when 2 then 'northern_italy'
                    when 3 then 'italy_default' else 'elsewhere' end as macroregion
        from orders join fx_static s on s.cell_id = o_custkey""",
    # diamonds around a lattice position, four vertices each
    "fx_hazard": f"""
        select p_partkey as geom_id,
               cast(10.003 as double) + cast(0.01 as double) * {_PCOL} as cx,
               cast(38.002 as double) + cast(0.01 as double) * {_PROW} as cy,
               cast(0.00413 as double) + cast(0.000713 as double) * p_size as rx,
               cast(0.00317 as double) + cast(0.000419 as double) * p_size as ry,
               case p_partkey % 6 when 0 then 'AA' when 1 then 'P1' when 2 then 'P2' when 3 then 'P3' when 4 then 'P4' else 'UNKNOWN' end as hazard_class,
               p_brand as authority, p_type as label
        from part""",
    "fx_network": f"""
        select s_suppkey as id, case when s_suppkey % 3 = 0 then 'rail' else 'road' end as kind,
               case s_suppkey % 4 when 0 then 'motorway' when 1 then 'trunk' when 2 then 'primary' else 'secondary' end as class,
               cast(10.0041 as double) + cast(0.01 as double) * {_SCOL} as x,
               cast(38.0037 as double) + cast(0.01 as double) * {_SROW} as y
        from supplier""",
    # short line segments starting at the network points
    "fx_faults": """
        select id, x as x1, y as y1, x + cast(0.011 as double) + cast(id % 7 as double) * cast(0.003 as double) as x2,
               y + cast(0.004 as double) - cast(id % 5 as double) * cast(0.005 as double) as y2
        from fx_network""",
    # ground pixels: 5 x 5 per cell, height and land-cover code by formula
    "fx_pixels": """
        select c_custkey as cell_id, cast(floor(n / cast(5 as double)) as int) as row, cast(n % 5 as int) as col,
               cast(100 + c_custkey % 50 as double) + cast(n % 5 as double) * cast(c_custkey % 7 as double)
                 + cast(n * n % 11 as double) * cast(0.37 as double) as z,
               c_custkey * 31 % 9 + n * 17 % 4 as code
        from (select c_custkey, unnest(generate_series(0, 24)) as n from customer) px""",
    # radar pixels: one per event on the cell lattice, which grows with the events
    "fx_radar": f"""
        select event_id, cast(10 as double) + cast(0.01 as double) * {_bits("event_id", 0)} as x,
               cast(38 as double) + cast(0.01 as double) * {_bits("event_id", 1)} as y,
               case when event_id % 17 = 0 then cast(-9999 as double) else value end as mm_h
        from events""",
    # inventory points: one per embedding, scattered inside the lattice
    "fx_inventory": f"""
        select vec_id as id, label,
               cast(10.0023 as double) + cast(0.01 as double) * {_VCOL} as x,
               cast(38.0011 as double) + cast(0.01 as double) * {_VROW} as y,
               concat('M', label) as movement_code
        from embeddings""",
    "fx_slides": """
        select event_id, event_id % (select count(*) from customer) as cell_id, ts as event_time, value
        from events where event_type = 'error'""",
    # dated events per cell on the time axis of the assessments
    "fx_truth": f"""
        select o_orderkey as event_id, o_custkey as cell_id, o_orderdate + (o_orderkey % 40 + 1) * interval '1' day as event_time,
               cast(10.0017 as double) + cast(0.01 as double) * {_bits("o_custkey", 0)} + cast(o_orderkey % 5 as double) * cast(0.0009 as double) as x,
               cast(38.0013 as double) + cast(0.01 as double) * {_bits("o_custkey", 1)} + cast(o_orderkey % 7 as double) * cast(0.0005 as double) as y
        from orders where o_totalprice >= cast(330000 as double)""",
    "fx_samples": """
        select d.doc_id as cell_id, d.source as split_block, l.quality as label,
               cast(d.n_chars as double) as n_chars,
               cast(length(d.text) - length(replace(d.text, ' ', '')) as double) as n_blanks,
               cast(length(d.text) - length(replace(d.text, '.', '')) as double) as n_stops,
               cast(l.toxic as double) as toxic,
               cast(d.doc_id * 37 % 101 as double) / cast(100 as double) as noise
        from documents d join labels l on l.doc_id = d.doc_id""",
    "fx_scored": """
        select cell_id, split_block, label,
               round(cast(0.6 as double) * noise + cast(0.4 as double) * label * (n_chars % 10) / cast(10 as double), 4) as prob
        from fx_samples""",
}
