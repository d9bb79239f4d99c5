"""Weather payloads: parallel hourly arrays, node grids, trailing totals, flood signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.schemas import HOURLY_WEATHER

SAMPLE_FIELDS = ("precipitation", "soil_moisture_0_to_7cm", "soil_moisture_7_to_28cm", "snowfall", "snow_depth")


def rain_nodes(bbox: tuple[float, float, float, float], step: float) -> tuple[list[float], list[float]]:
    """Axes of the inclusive node lattice over a box."""
    x0, y0, x1, y1 = bbox
    nx, ny = int((x1 - x0 + 1e-9) / step) + 1, int((y1 - y0 + 1e-9) / step) + 1
    return [x0 + i * step for i in range(nx)], [y0 + j * step for j in range(ny)]


def node_table(boxes: DataFrame, step: float) -> DataFrame:
    """Node rows per box (``minx..maxy``), numbered row by row; the centre where a box is empty."""
    count = lambda lo, hi: F.floor((F.col(hi) - F.col(lo) + 1e-9) / step)
    axis = lambda lo, hi: F.sequence(F.lit(0).cast("bigint"), count(lo, hi))
    empty = (F.col("maxx") < F.col("minx")) | (F.col("maxy") < F.col("miny"))
    full = boxes.filter(~empty).withColumn("_j", F.explode(axis("miny", "maxy"))).withColumn("_i", F.explode(axis("minx", "maxx")))
    grid = full.withColumns(
        {
            "node_idx": F.col("_j") * (count("minx", "maxx") + 1) + F.col("_i"),
            "lon": F.col("minx") + F.col("_i") * step,
            "lat": F.col("miny") + F.col("_j") * step,
        }
    ).drop("_i", "_j")
    centre = boxes.filter(empty).withColumns(
        {"node_idx": F.lit(0).cast("bigint"), "lon": (F.col("minx") + F.col("maxx")) / 2, "lat": (F.col("miny") + F.col("maxy")) / 2}
    )
    return grid.unionByName(centre)


def nearest_lattice_node(lon: Column, lat: Column, bbox: tuple[float, float, float, float], step: float) -> tuple[Column, Column]:
    """Closed form of the nearest node on a regular lattice; a tie keeps the lower index."""
    xs, ys = rain_nodes(bbox, step)

    def index(v: Column, low: float, n: int) -> Column:
        # half a step rounds down, so the earlier node wins; 1e-9 absorbs float noise
        i = F.ceil((v - low) / step - 0.5 - 1e-9)
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), i)).cast("bigint")

    return index(lon, xs[0], len(xs)), index(lat, ys[0], len(ys))


def parse(payload: Column | str) -> Column:
    """Typed view of one payload; malformed text becomes a struct of nulls."""
    return F.from_json(payload, HOURLY_WEATHER)


def hourly_samples(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per hour; missing rain counts as 0, other missing values stay null."""
    p = df.withColumn("_p", parse(F.col(payload))).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_p.hourly.time"))))
    at = lambda name: F.try_element_at(F.col(f"_p.hourly.{name}"), F.col("_i"))
    return p.filter(F.size("_p.hourly.time") > 0).withColumns(
        {
            "ts": F.to_timestamp(at("time")),
            "precipitation_mm": F.coalesce(at("precipitation"), F.lit(0.0)),
            "soil_moisture_0_7": at("soil_moisture_0_to_7cm"),
            "soil_moisture_7_28": at("soil_moisture_7_to_28cm"),
            "snowfall_cm": at("snowfall"),
            "snow_depth_m": at("snow_depth"),
        }
    ).drop("_p", "_i", payload)


def window(samples: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Samples inside [start, stop]."""
    return samples.filter(F.col("ts").between(start, stop))


def node_series(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rain per node of a batch answer: a list, or one object for a single node.

    A failed request is a null payload and gives one row with no samples.
    """
    text = F.trim(F.col(payload))
    as_list = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    nodes = df.withColumn("_l", F.from_json(as_list, f"array<{HOURLY_WEATHER.simpleString()}>"))
    each = nodes.select(*[c for c in df.columns if c != payload], F.posexplode_outer("_l").alias("node_pos", "_n"))
    zipped = F.transform(
        F.col("_n.hourly.time"),
        lambda t, i: F.struct(F.to_timestamp(t).alias("ts"), F.coalesce(F.get(F.col("_n.hourly.precipitation"), i), F.lit(0.0)).alias("mm")),
    )
    rows = each.withColumn("_s", F.explode_outer(zipped))
    return rows.select(*[c for c in df.columns if c != payload], "node_pos", "_s.ts", "_s.mm")


def trailing_total(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Sum of the daily rain array, nulls skipped."""
    daily = F.col("_p.daily.precipitation_sum")
    total = F.aggregate(F.coalesce(daily, F.array().cast("array<double>")), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return df.withColumn("_p", parse(F.col(payload))).withColumn("total_mm", total).drop("_p", payload)


# --- fixed value: wave height that counts as a full coastal signal ------------
WAVE_REFERENCE_M = 4.0


def flood_signals(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Forecast rain sum, discharge against normal, normalised wave height."""
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<double>")), lambda v: v.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    p = df.withColumn("_p", parse(F.col(payload))).withColumns(
        {"_r": clean(F.col("_p.hourly.precipitation")), "_q": clean(F.col("_p.daily.river_discharge")), "_w": clean(F.col("_p.hourly.wave_height"))}
    )
    n = F.size("_q")
    past = F.slice("_q", 1, F.greatest(n - 7, F.lit(0)))
    base = total(past) / F.size(past)
    peak = F.array_max(F.slice("_q", F.greatest(n - 6, F.lit(1)), F.lit(7)))
    return p.withColumns(
        {
            "rain_72h_mm": F.when(F.size("_r") > 0, total(F.col("_r"))),
            "discharge_ratio": F.when((n >= 8) & (base > 0), peak / base),
            "coastal_surge": F.when(F.size("_w") > 0, F.least(F.lit(1.0), F.array_max("_w") / WAVE_REFERENCE_M)),
        }
    ).drop("_p", "_r", "_q", "_w", payload)
