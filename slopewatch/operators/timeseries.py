"""Rain series: events, antecedent sums, axes and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.basic import horizon_hours
from slopewatch.operators.running import numbered, sliced_running, time_slice
from slopewatch.params import PARAMS

HOUR_S = 3600


def rain_events(series: DataFrame, key: str = "series_id", ts: str = "ts", mm: str = "mm",
                dry_samples: int | None = None, min_mm: float | None = None,
                slice_hours: float = 720.0) -> DataFrame:
    """Rain events per series: a run of dry *samples* closes one, small ones are dropped.

    Columns: key, ``event``, ``start``, ``stop``, ``end_seq``, ``total_mm``,
    ``duration_h``. Series are cut into time slices, so a long one is spread.
    """
    gap = dry_samples if dry_samples is not None else PARAMS["rain_event"]["dry_samples"]
    least = min_mm if min_mm is not None else PARAMS["rain_event"]["min_mm"]
    base = series.select(key, ts, mm).withColumn("_slice", time_slice(F.col(ts), slice_hours))
    seq = numbered(base, [key], "_slice", [ts])
    wet = seq.filter(F.col(mm) > 0)
    marked = sliced_running(wet, [key], "_slice", ["seq"], prior_maxes={"last_wet": F.col("seq")})
    starts = F.when(F.col("seq") - F.col("last_wet") - 1 >= gap, 1).otherwise(0)
    numbered_events = sliced_running(marked, [key], "_slice", ["seq"], sums={"event": starts})
    out = numbered_events.groupBy(key, "event").agg(
        F.min(ts).alias("start"), F.max(ts).alias("stop"), F.max("seq").alias("end_seq"), F.sum(mm).alias("total_mm")
    )
    hours = (F.unix_micros(F.col("stop").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 3.6e9
    return out.filter(F.col("total_mm") >= least).withColumn("duration_h", F.greatest(F.lit(1.0), hours + 1.0))


def latest_event(events: DataFrame, key: str = "series_id") -> DataFrame:
    """Last qualifying event per series."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), "end_seq").alias("_e")).select(key, "_e.*")


def trailing_window(series: DataFrame, hours: float, key: str = "series_id", ts: str = "ts") -> DataFrame:
    """Samples of the last ``hours`` before each series' newest sample."""
    newest = series.groupBy(key).agg(F.max(ts).alias("_newest"))
    age = F.unix_micros(F.col("_newest").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return series.join(newest, key).filter(age <= int(hours * 3.6e9)).drop("_newest")


def antecedent_index(daily: DataFrame, decay: float | None = None, key: str = "series_id",
                     day: str = "day", mm: str = "mm") -> DataFrame:
    """Recursive precipitation index ``k * previous + today`` at each series' end.

    Closed form: every day weighs ``k`` to the number of days after it, which
    aggregates on the map side instead of folding an ordered list.
    """
    k = decay if decay is not None else PARAMS["api"]["decay"]
    checked = F.when(F.col(mm) >= 0, F.col(mm)).otherwise(F.raise_error(F.lit("rain must not be negative")).cast("double"))
    base = daily.withColumn("_slice", F.floor(F.unix_date(F.col(day).cast("date")) / 365))
    seq = numbered(base, [key], "_slice", [day])
    size = daily.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    weight = F.pow(F.lit(float(k)), (F.col("_n") - F.col("seq")).cast("double"))
    return seq.join(size, key).groupBy(key).agg(F.sum(checked * weight).alias("api_mm"))


def antecedent_rain(points: DataFrame, samples: DataFrame, key: str = "node_id", at: str = "as_of",
                    ts: str = "ts", mm: str = "mm") -> DataFrame:
    """Append 24 h, 72 h and 30 d rain and the 24 h peak at each evaluation time.

    Bounds are inclusive. Samples and evaluation times share one ordered range
    window per (series, 30-day bucket); each sample is repeated in the next
    bucket only, so no pair of sample and evaluation time is ever formed.
    """
    width = 30 * 24 * HOUR_S * 1_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    merged = samples.groupBy(key, us(ts).alias("_us")).agg(F.sum(mm).alias("_mm"), F.max(mm).alias("_peak"))
    home = F.floor(F.col("_us") / width)
    nil = lambda t: F.lit(None).cast(t)
    row = F.struct(*points.columns)
    s = merged.withColumn("_b", F.explode(F.array(home, home + 1))).select(
        key, "_b", "_us", "_mm", "_peak", nil(points.select(row.alias("r")).schema["r"].dataType).alias("_p")
    )
    q = points.select(
        key, F.floor(us(at) / width).alias("_b"), us(at).alias("_us"), nil("double").alias("_mm"), nil("double").alias("_peak"), row.alias("_p")
    )

    def back(hours: float) -> Window:
        return Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(-int(hours * HOUR_S * 1_000_000), 0)

    zero = F.lit(0.0)
    total = lambda h: F.round(F.coalesce(F.sum("_mm").over(back(h)), zero), 2)
    wide = s.unionByName(q).withColumns(
        {
            "rain_24h_mm": total(24),
            "rain_72h_mm": total(72),
            "rain_30d_mm": total(720),
            "max_i_24h_mmh": F.round(F.greatest(zero, F.coalesce(F.max("_peak").over(back(24)), zero)), 2),
            "_seen": F.count("_mm").over(back(720)),
        }
    )
    return wide.filter(F.col("_p").isNotNull()).select(
        "_p.*", "rain_24h_mm", "rain_72h_mm", "rain_30d_mm", "max_i_24h_mmh", (F.col("_seen") == 0).alias("degraded")
    )


def hourly_axis(bounds: DataFrame, start: str = "start", stop: str = "stop", name: str = "ts") -> DataFrame:
    """Every full hour from ``start`` to ``stop``, both included."""
    return bounds.withColumn(name, F.explode(F.sequence(F.col(start), F.col(stop), F.expr("interval 1 hour"))))


def series_from_aggregates(df: DataFrame, at: str, r24: str, r72: str) -> DataFrame:
    """Hourly series with the stored totals: 24 h at one mean rate, the older 48 h at theirs."""
    rain24 = F.coalesce(F.col(r24), F.lit(0.0))
    tail = F.greatest(F.lit(0.0), F.coalesce(F.col(r72), F.lit(0.0)) - rain24)
    hours = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(71))))
    rate = F.when(F.col("_i") < 24, rain24 / 24.0).otherwise(tail / 48.0)
    ts = F.col(at) - F.make_dt_interval(F.lit(0), F.col("_i") + 1)
    return hours.withColumns({"ts": ts, "mm": rate}).filter(F.col("mm") > 0).drop("_i")


def trend(assessments: DataFrame, as_of: Column, hours: int = 72) -> DataFrame:
    """Observed points of the last hours and forecast points at their target time."""
    forecast = F.col("horizon").startswith("+")
    observed = assessments.filter(~forecast & (F.col("computed_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))).select(
        "cell_id", F.col("computed_at").alias("t"), "score", F.lit("observed").alias("kind")
    )
    ahead = assessments.filter(forecast).select(
        "cell_id",
        (F.col("computed_at") + F.make_dt_interval(hours=horizon_hours("horizon"))).alias("t"),
        "score",
        F.lit("forecast").alias("kind"),
    )
    return observed.unionByName(ahead)
