"""In-situ sensors in batch: quality labels, hourly features, movement."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.basic import lookup
from slopewatch.operators.running import blocked, sliced_running, time_slice
from slopewatch.params import PARAMS

# --- fixed values: labels from best to worst --------------------------------
QUALITY = ("ok", "gap", "flatline", "spike", "range", "unit")


def range_ok(prop: Column, value: Column, p: dict[str, Any] = PARAMS) -> Column:
    limits = p["sensor"]["range"]
    low = lookup({k: float(v[0]) for k, v in limits.items()}, prop)
    high = lookup({k: float(v[1]) for k, v in limits.items()}, prop)
    return value.between(low, high)


def unit_ok(prop: Column, unit: Column, p: dict[str, Any] = PARAMS) -> Column:
    return F.trim(unit) == lookup(p["sensor"]["unit"], prop)


def worst_label(unit_bad: Column, range_bad: Column, spike: Column, flat: Column, gap: Column) -> Column:
    """The most severe failed check."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(unit_bad), "unit").when(yes(range_bad), "range").when(yes(spike), "spike")
        .when(yes(flat), "flatline").when(yes(gap), "gap").otherwise("ok")
    )


def quality(obs: DataFrame, p: dict[str, Any] = PARAMS, block_rows: int = 200_000) -> DataFrame:
    """Label each observation from its predecessors in the same device and property.

    Needs ``device_id, observed_property, phenomenon_time, result_value, id``
    and optionally ``result_unit``. Long streams are cut into blocks with an
    eleven-row look-back, so one busy device is many tasks.
    """
    cfg = p["sensor"]
    need = cfg["flatline_samples"] - 1
    keys = ["device_id", "observed_property"]
    base = obs.withColumn("_slice", time_slice(F.col("phenomenon_time")))
    cut = blocked(base, keys, "_slice", ["phenomenon_time", "id"], lookback=need, block_rows=block_rows)
    w = Window.partitionBy(*keys, "block").orderBy("seq")
    last = w.rowsBetween(-need, -1)
    v = F.col("result_value")
    prev, prev_ts = F.lag("result_value").over(w), F.lag("phenomenon_time").over(w)
    gap_us = F.unix_micros(F.col("phenomenon_time").cast("timestamp")) - F.unix_micros(prev_ts.cast("timestamp"))
    flat = (F.count("result_value").over(last) == need) & (F.min("result_value").over(last) == v) & (F.max("result_value").over(last) == v)
    unit_bad = ~unit_ok(F.col("observed_property"), F.col("result_unit"), p) if "result_unit" in obs.columns else F.lit(False)
    marked = cut.withColumns(
        {
            "spike": F.coalesce(F.abs(v - prev) > cfg["spike_factor"] * lookup(cfg["sigma"], F.col("observed_property")), F.lit(False)),
            "flatline": F.coalesce(flat, F.lit(False)),
            "gap": F.coalesce(gap_us > cfg["gap_minutes"] * 60_000_000, F.lit(False)),
            "out_of_range": ~range_ok(F.col("observed_property"), v, p),
            "bad_unit": unit_bad,
        }
    ).filter(~F.col("is_context"))
    label = worst_label(F.col("bad_unit"), F.col("out_of_range"), F.col("spike"), F.col("flatline"), F.col("gap"))
    return marked.withColumn("quality", label).drop("_slice", "block", "is_context")


def hourly_features(obs: DataFrame, bucket: Column, keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """Per device and bucket: rain summed, pore pressure and soil averaged, last displacement, velocity.

    Only rows labelled ok count. Velocity is the least-squares slope in mm/day.
    """
    prop, v = F.col("observed_property"), F.col("result_value")
    of = lambda name: F.when(prop == name, v)
    is_disp = prop == "displacement"
    days = F.when(is_disp, (F.unix_micros(F.col("phenomenon_time").cast("timestamp")) - F.unix_micros(F.col("bucket").cast("timestamp"))) / 8.64e10)
    used = F.col("quality").eqNullSafe(F.lit("ok")) & prop.isin("rainfall", "pore_pressure", "soil_moisture", "displacement")
    rows = obs.filter(used).withColumn("bucket", bucket)
    return rows.groupBy(*keys, "bucket").agg(
        F.sum(of("rainfall")).alias("rainfall_mm"),
        F.avg(of("pore_pressure")).alias("pore_pressure_kpa"),
        F.avg(of("soil_moisture")).alias("soil_moisture"),
        F.max_by(of("displacement"), F.when(is_disp, F.struct("phenomenon_time", "id"))).alias("displacement_mm"),
        F.when(F.count(of("displacement")) > 1, F.regr_slope(of("displacement"), days)).alias("velocity_mmd"),
        F.count(F.lit(1)).alias("sample_count"),
        F.max("phenomenon_time").alias("last_observation_at"),
    )


FEATURES = ("rainfall_mm", "pore_pressure_kpa", "soil_moisture", "displacement_mm", "velocity_mmd")


def merge_devices(features: DataFrame, cell: str = "cell_id") -> DataFrame:
    """One row per cell and bucket: first non-null by device id, counts add, greatest time."""
    return features.groupBy(cell, "bucket").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("device_id"))).alias(c) for c in FEATURES],
        F.sum("sample_count").alias("sample_count"),
        F.max("last_observation_at").alias("last_observation_at"),
    )


def with_motion(features: DataFrame, cell: str = "cell_id", slice_hours: float = 720.0) -> DataFrame:
    """Add acceleration against the last earlier velocity, and inverse velocity."""
    base = features.withColumn("_slice", time_slice(F.col("bucket"), slice_hours))
    known = F.when(F.col("velocity_mmd").isNotNull(), F.struct("bucket", "velocity_mmd"))
    got = sliced_running(base, [cell], "_slice", ["bucket"], prior_maxes={"_prev": known})
    v = F.col("velocity_mmd")
    return got.withColumns(
        {
            "prev_velocity": F.col("_prev.velocity_mmd"),
            "acceleration_mmd2": (v - F.col("_prev.velocity_mmd")) * 24.0,
            "inverse_velocity": F.when(v > 1e-6, 1.0 / v),
        }
    ).drop("_prev", "_slice")
