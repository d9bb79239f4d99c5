"""Monitoring and forecast runs: one plan for all areas, no loop over cells."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.functions.scoring import decayed_pga, months_since, nominal_pga, rain_excess, regional, score_with
from slopewatch.operators.relational import lookup_join, small_enough
from slopewatch.operators.rollup import selected_for_alert, with_exposure
from slopewatch.operators.timeseries import latest_event, rain_events
from slopewatch.params import PARAMS
from slopewatch.sinks.tables import assessment_rows


def rain_features(rain: DataFrame, as_of: Column, key: str = "node_id") -> DataFrame:
    """Per rain node: latest event, 24 h and 30 d sums at the valuation time."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    at = F.unix_micros(as_of.cast("timestamp"))
    past = rain.filter(us <= at)
    age_h = (at - us) / 3.6e9
    sums = past.groupBy(key).agg(
        F.sum(F.when(age_h <= 24, F.col("mm"))).alias("rain_24h_mm"), F.sum(F.when(age_h <= 720, F.col("mm"))).alias("node_api_mm")
    )
    last = latest_event(rain_events(past.filter(age_h <= 48), key), key)
    return sums.join(last.select(key, F.col("total_mm").alias("event_mm"), F.col("duration_h").alias("event_hours")), key, "left")


def seismic_peak(quakes: DataFrame, as_of: Column, p: dict[str, Any] = PARAMS) -> DataFrame:
    """One row: strongest decayed ground motion. The history is not spatial, as in operation."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("origin_time").cast("timestamp"))) / 8.64e10
    return quakes.agg(F.max(decayed_pga(nominal_pga(F.col("magnitude")), F.col("magnitude"), age, p)).alias("pga_g"))


def assemble(cells: DataFrame, static: DataFrame, nodes: DataFrame, areas: DataFrame, sensors: DataFrame | None = None,
             pga: DataFrame | None = None) -> DataFrame:
    """One wide input row per cell: node rain (area series where the node has none), area scalars, sensors.

    ``cells`` carry ``node_id``; ``areas`` may hold ``event_mm, event_hours,
    rain_24h_mm`` as the fallback series, and the scalar inputs.
    """
    spare = [c for c in ("event_mm", "event_hours", "rain_24h_mm") if c in areas.columns]
    a = areas.withColumnsRenamed({c: f"_area_{c}" for c in spare})
    node = nodes.withColumn("_node", F.lit(True))
    b = lookup_join(lookup_join(cells.join(static, "cell_id", "left"), node, "node_id"), a, "aoi_id")
    # the whole node series or the whole area series, never a mixture
    pick = {c: F.when(F.col("_node"), F.col(c)).otherwise(F.col(f"_area_{c}")) for c in spare}
    b = b.withColumns(pick).drop("_node", *[f"_area_{c}" for c in spare])
    if sensors is not None:
        b = b.join(
            sensors.select(
                "cell_id", F.col("rainfall_mm").alias("sensor_rainfall_mm"), F.col("pore_pressure_kpa").alias("sensor_pore_kpa"),
                F.col("soil_moisture").alias("sensor_soil"), "velocity_mmd", "acceleration_mmd2", "inverse_velocity",
            ),
            "cell_id", "left",
        )
    if pga is not None:
        b = b.withColumn("pga_g", pga.scalar())
    return b.withColumn("caine_excess", rain_excess(F.col("event_mm"), F.col("event_hours"), F.lit("italy_default")))


def run(bundle: DataFrame, as_of: Column, horizon: str = "24h", scorer: str = "deterministic", p: dict[str, Any] = PARAMS) -> tuple[DataFrame, DataFrame]:
    """(assessment rows, alert candidates with priority) of one run."""
    scored = score_with(bundle, scorer, p)
    pipeline = "v1" if not horizon.startswith("+") else f"v1-forecast{horizon}"
    rows = assessment_rows(scored, as_of, horizon, pipeline)
    flat = scored.withColumn("s", F.col("breakdown.s"))
    exposed = with_exposure(selected_for_alert(flat, p), p) if "landuse_code" in bundle.columns else selected_for_alert(flat, p).withColumn(
        "exposure", F.struct(F.lit(0.0).alias("factor"), F.array().cast("array<string>").alias("tags"))
    )
    return rows, exposed.withColumn("priority", F.col("score") * (1 + F.col("exposure.factor")))


def forecast_sweep(cells: DataFrame, static: DataFrame, rain: DataFrame, areas: DataFrame, as_of: Any, horizons: tuple[int, ...] = (24, 48, 72),
                   p: dict[str, Any] = PARAMS) -> DataFrame:
    """Forecast rows at each horizon, kept from Moderate upwards, in one plan.

    Horizons become part of the rain node's key, so all of them share one scan
    and one scoring projection. Antecedent sums of the areas stop at the run time.
    """
    from slopewatch.functions.basic import at_least

    ahead = F.explode(F.array(*[F.lit(h) for h in horizons]))
    target = as_of + F.make_dt_interval(hours=F.col("node_id.h"))
    keyed = lambda df: df.withColumn("_h", ahead).withColumn("node_id", F.struct("node_id", F.col("_h").alias("h"))).drop("_h")
    bundle = assemble(keyed(cells), static, rain_features(keyed(rain), target), areas)
    tag = F.concat(F.lit("+"), F.col("node_id.h").cast("string"), F.lit("h"))
    rows = assessment_rows(score_with(bundle, "deterministic", p), as_of, tag, F.concat(F.lit("v1-forecast"), tag))
    return rows.filter(at_least("level", "Moderate"))


def months_since_area_fire(fires: DataFrame, as_of: Column) -> DataFrame:
    """Months since the newest fire touching each area; null outside the window."""
    last = fires.groupBy("aoi_id").agg(F.max("fire_date").alias("d"))
    return last.select("aoi_id", months_since(F.col("d"), as_of.cast("date")).alias("months_since_fire"))


def with_region(df: DataFrame, table: DataFrame, block: dict[str, Any] = PARAMS["rain_threshold"]) -> DataFrame:
    """Macroregion law parameters per row, default where the region is unknown."""
    j = df.join(F.broadcast(table) if small_enough(table) else table, "aoi_id", "left")
    return j.withColumns({"alpha": regional(block, "alpha"), "beta": regional(block, "beta")})
