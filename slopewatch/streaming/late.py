"""Hourly features of a stream in which rows may arrive at any time.

A micro-batch leaves three things in the shared folder, each under its own
number, so that a repeated batch replaces itself: its observations by day, the
partial aggregates of the hours that are still open, and whole rows of closed hours
that late observations reached, computed anew from all stored observations.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewatch.operators.relational import latest_per_key
from slopewatch.streaming.ingest import recompute_hours

USED = ("rainfall", "pore_pressure", "soil_moisture", "displacement")
_TREND = "struct<n: double, x: double, y: double, xy: double, xx: double>"


def hourly_partials(rows: DataFrame, bucket: Column, keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """What ``hourly_features`` needs of some rows of an hour, in a form that can be merged with the rest.

    The trend keeps means and centred moments, as sums of squares would lose the digits of close times.
    """
    prop, v = F.col("observed_property"), F.col("result_value")
    of = lambda name: F.when(prop == name, v)
    moved = prop == "displacement"
    days = F.when(moved, (F.unix_micros(F.col("phenomenon_time").cast("timestamp")) - F.unix_micros(F.col("bucket").cast("timestamp"))) / 8.64e10)
    n = F.count(of("displacement"))
    kept = rows.filter(F.col("quality").eqNullSafe(F.lit("ok")) & prop.isin(*USED)).withColumn("bucket", bucket)
    return kept.groupBy(*keys, "bucket").agg(
        F.sum(of("rainfall")).alias("rain"), F.sum(of("pore_pressure")).alias("pore"), F.count(of("pore_pressure")).alias("pores"),
        F.sum(of("soil_moisture")).alias("soil"), F.count(of("soil_moisture")).alias("soils"),
        F.max(F.when(moved, F.struct("phenomenon_time", "id", v.alias("v")))).alias("moved"),
        F.struct(n.cast("double").alias("n"), F.avg(F.when(of("displacement").isNotNull(), days)).alias("x"), F.avg(of("displacement")).alias("y"),
                 (F.covar_pop(days, of("displacement")) * n).alias("xy"), (F.var_pop(F.when(of("displacement").isNotNull(), days)) * n).alias("xx")).alias("trend"),
        F.count(F.lit(1)).alias("rows"), F.max("phenomenon_time").alias("last_observation_at"),
    )


def merged_hours(parts: DataFrame, keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """Features of hours from their partial aggregates, in the columns of ``hourly_features``."""

    def both(a: Column, b: Column) -> Column:
        n = a.n + b.n
        dx, dy = b.x - a.x, b.y - a.y
        share = a.n * b.n / n
        met = F.struct(n.alias("n"), (a.x + dx * b.n / n).alias("x"), (a.y + dy * b.n / n).alias("y"),
                       (a.xy + b.xy + dx * dy * share).alias("xy"), (a.xx + b.xx + dx * dx * share).alias("xx"))
        return F.when(a.n == 0, b).when(b.n == 0, a).otherwise(met).cast(_TREND)

    none = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "x", "y", "xy", "xx")]).cast(_TREND)
    told = parts.groupBy(*keys, "bucket").agg(
        F.sum("rain").alias("rainfall_mm"), (F.sum("pore") / F.nullif(F.sum("pores"), F.lit(0))).alias("pore_pressure_kpa"),
        (F.sum("soil") / F.nullif(F.sum("soils"), F.lit(0))).alias("soil_moisture"), F.max("moved").alias("moved"),
        F.aggregate(F.collect_list(F.col("trend").cast(_TREND)), none, both).alias("t"),  # one entry per batch that reached the hour
        F.sum("rows").alias("sample_count"), F.max("last_observation_at").alias("last_observation_at"),
    )
    slope = F.when((F.col("t.n") > 1) & (F.col("t.xx") > 0), F.col("t.xy") / F.col("t.xx"))
    return told.select(
        *keys, "bucket", "rainfall_mm", "pore_pressure_kpa", "soil_moisture", F.col("moved.v").alias("displacement_mm"), slope.alias("velocity_mmd"),
        "sample_count", "last_observation_at",
    )


class HourStore:
    """Takes micro-batches of labelled observations and tells the features of every hour seen so far.

    An hour is closed once observations ``delay_minutes`` beyond its end have been
    seen in earlier batches. Rows of open hours add a partial aggregate; a row of a
    closed hour has its (device, hour) pair computed again from the stored
    observations of that day. Nothing is lost however late it comes, and no state is kept in memory.
    """

    def __init__(self, spark: SparkSession, base: str, delay_minutes: int = 120) -> None:
        self.spark, self.base, self.delay_us = spark, base, delay_minutes * 60_000_000

    def _read(self, kind: str) -> DataFrame | None:
        """All batches' rows of a kind with ``batch_id``; none yet: None."""
        try:
            return self.spark.read.parquet(f"{self.base}/{kind}")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _write(self, rows: DataFrame, kind: str, batch_id: int, *by: str) -> None:
        numbered = rows.withColumn("batch_id", F.lit(batch_id))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch_id").parquet(f"{self.base}/{kind}")

    def mark(self, batch_id: int) -> int | None:
        """Latest event time, in microseconds, of the batches before."""
        marks = self._read("marks")
        return None if marks is None else marks.filter(F.col("batch_id") < batch_id).agg(F.max("us")).first()[0]

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Store one micro-batch; taking the same batch again changes nothing."""
        hour = F.date_trunc("hour", "phenomenon_time")
        rows = batch.withColumn("day", F.to_date("phenomenon_time"))
        self._write(rows, "observations", batch_id, "day")
        mark = self.mark(batch_id)
        stored = self._read("observations")
        if stored is None:
            return
        mine = stored.filter(F.col("batch_id") == batch_id)
        us = F.unix_micros(F.col("phenomenon_time").cast("timestamp"))
        self._write(mine.agg(F.max(us).alias("us")).filter(F.col("us").isNotNull()), "marks", batch_id)
        closed = F.lit(False) if mark is None else F.unix_micros(hour.cast("timestamp")) + 3_600_000_000 + self.delay_us <= mark
        self._write(hourly_partials(mine.filter(~closed), hour), "partials", batch_id)
        if mark is None:
            return
        late = mine.filter(closed).select("device_id", "phenomenon_time", "day")
        on_days = stored.filter(F.col("batch_id") <= batch_id).join(late.select("day").distinct(), "day", "left_semi")
        self._write(recompute_hours(on_days, late), "repairs", batch_id)

    def hours(self) -> DataFrame:
        """Features of all hours: the latest repair of a (device, hour) pair, or else its merged partials."""
        parts, repairs = self._read("partials"), self._read("repairs")
        if parts is None and repairs is None:
            raise ValueError(f"no batch has been taken in {self.base}")
        whole = None if parts is None else merged_hours(parts)
        if repairs is None:
            return whole
        latest = latest_per_key(repairs, ["device_id", "bucket"], ["batch_id"]).drop("batch_id")
        if whole is None:
            return latest
        return whole.join(latest.select("device_id", "bucket"), ["device_id", "bucket"], "left_anti").unionByName(latest.select(*whole.columns))

    def rain_windows(self, hours: int) -> DataFrame:
        """(device_id, as_of, mm, n): rain and wet readings of the ``hours`` before every full hour that any rain reaches.

        Sums over hours of the stored observations, so that late rain reaches all windows it belongs to.
        """
        rain = self._read("observations").filter((F.col("observed_property") == "rainfall") & F.col("quality").eqNullSafe(F.lit("ok")))
        by_hour = rain.groupBy("device_id", F.date_trunc("hour", "phenomenon_time").alias("_h")).agg(F.sum("result_value").alias("mm"), F.count(F.lit(1)).alias("n"))
        reached = by_hour.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(hours)))).withColumn("as_of", F.col("_h") + F.make_dt_interval(hours=F.col("_i")))
        return reached.groupBy("device_id", "as_of").agg(F.sum("mm").alias("mm"), F.sum("n").alias("n"))

    def run(self, stream: DataFrame) -> HourStore:
        """Take everything that is there, batch by batch, going on where an earlier run ended."""
        query = (
            stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.base}/checkpoint")
            .trigger(availableNow=True).start()
        )
        try:
            query.awaitTermination()
            if query.exception() is not None:
                raise query.exception()
        finally:
            query.stop()
        return self
