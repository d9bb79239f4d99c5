"""Sensor messages: contract, rejects, enrichment, quality state and hourly features.

Each stage is a DataFrame transform that works on a stream and on a batch; only
the quality labels need keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slopewatch.functions.basic import calibrated, lookup
from slopewatch.operators.relational import latest_per_key
from slopewatch.operators.sensors import hourly_features, unit_ok
from slopewatch.params import PARAMS
from slopewatch.schemas import OBSERVATION
from slopewatch.session import ROCKSDB_PROVIDER, shared_path

TOPIC_ROOT = "hazard"
CONTRACT_KEYS = [f.name for f in OBSERVATION.fields if not f.name.startswith("_")]


def kafka_messages(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """Topic and payload text from a Kafka bridge of the sensor broker."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", topics).load()
    return raw.select(F.coalesce(F.col("key").cast("string"), F.col("topic")).alias("topic"), F.col("value").cast("string").alias("payload"))


def file_messages(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Landed message files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def parse(messages: DataFrame, root: str = TOPIC_ROOT) -> DataFrame:
    """Typed observation columns plus ``reject``: why a message breaks the contract, or null.

    Seven topic parts, no unknown keys, a known property, a time with a zone,
    a version ``v`` and digits, a non-empty unit of at most 32 characters.
    """
    parts = F.split("topic", "/")
    m = messages.withColumns(
        {
            "_topic_ok": (F.size(parts) == 7) & (F.get(parts, F.lit(0)) == root) & (F.get(parts, F.lit(6)) == "obs"),
            "_thing": F.get(parts, F.lit(4)),
            "_o": F.from_json("payload", OBSERVATION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}),
            "_keys": F.json_object_keys("payload"),
        }
    )
    o = F.col("_o")
    zoned = o["phenomenon_time"].rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    time = F.try_to_timestamp(o["phenomenon_time"])
    ok = (
        o["_bad"].isNull() & (F.size(F.array_except("_keys", F.array(*[F.lit(k) for k in CONTRACT_KEYS]))) == 0)
        & F.coalesce(o["contract_version"], F.lit("v1")).rlike(r"^v\d+$") & (F.length(o["thing_id"]) > 0)
        & lookup(PARAMS["sensor"]["unit"], o["observed_property"]).isNotNull() & zoned & time.isNotNull()
        & o["result_value"].isNotNull() & F.length(o["result_unit"]).between(1, 32)
    )
    reject = (
        F.when(~F.coalesce("_topic_ok", F.lit(False)), "bad_topic")
        .when(~F.coalesce(ok, F.lit(False)), "bad_payload")
        .when(o["thing_id"] != F.col("_thing"), "thing_mismatch")
    )
    keep = [c for c in messages.columns if c != "payload"]
    return m.select(
        *keep, o["thing_id"].alias("device_id"), o["observed_property"].alias("observed_property"), time.alias("phenomenon_time"),
        o["result_value"].alias("raw_value"), o["result_unit"].alias("result_unit"), o["metadata"].alias("metadata"), reject.alias("reject"),
    )


def enrich(parsed: DataFrame, devices: DataFrame) -> DataFrame:
    """Stream-static join with the device table; calibration and the last two reject reasons.

    The unit is checked before conversion, so a foreign unit can be flagged.
    """
    from slopewatch.operators.relational import small_enough

    d = devices.select("device_id", "status", "cell_id", "calibration")
    j = parsed.join(F.broadcast(d) if small_enough(d) else d, "device_id", "left")
    reject = F.coalesce(
        F.col("reject"), F.when(F.col("status").isNull(), "unknown_device").when(F.col("status") == "quarantined", "quarantined")
    )
    return j.withColumns(
        {
            "reject": reject,
            "bad_unit": ~F.coalesce(unit_ok(F.col("observed_property"), F.col("result_unit")), F.lit(False)),
            "result_value": calibrated(F.col("raw_value"), F.col("calibration"), F.col("observed_property")),
        }
    ).drop("calibration")


class QualityState(StatefulProcessor):
    """Per (device, property): the last eleven values and the last time decide the label.

    Rows are taken in chunks of ``chunk_rows`` and only what the next rows look back on is
    carried between them. With ``ttl_us`` a timer in event time forgets a series that has been silent so long.
    """

    def __init__(self, cfg: dict[str, Any], ttl_us: int | None = None, chunk_rows: int = 50_000) -> None:
        self.cfg, self.ttl_us, self.chunk_rows = cfg, ttl_us, chunk_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getValueState("history", "values array<double>, last_us bigint")

    def _labels(self, prop: str, chunk: pd.DataFrame, us: np.ndarray, past: np.ndarray, last_us: int | None) -> np.ndarray:
        """Labels of rows in order, seen after the values ``past``."""
        cfg = self.cfg
        v = chunk["result_value"].to_numpy(dtype="float64")
        series = np.concatenate([past, v])
        at = np.arange(len(past), len(series))
        prev = np.where(at > 0, series[at - 1], np.nan)
        prev_us = np.concatenate([[us[0] if last_us is None else last_us], us[:-1]])
        # length of the run of equal values that ends just before each row
        same = np.concatenate([[False], series[1:] == series[:-1]])
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(series))))
        run = at - start[at]
        low, high = cfg["range"].get(prop, (-np.inf, np.inf))
        label = np.full(len(v), "ok", dtype=object)
        label[(us - prev_us) > cfg["gap_minutes"] * 60_000_000] = "gap"
        label[run >= cfg["flatline_samples"] - 1] = "flatline"
        with np.errstate(invalid="ignore"):
            label[np.abs(v - prev) > cfg["spike_factor"] * cfg["sigma"].get(prop, np.inf)] = "spike"
        label[(v < low) | (v > high)] = "range"
        if "bad_unit" in chunk:
            label[chunk["bad_unit"].to_numpy(dtype=bool)] = "unit"
        return label

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        need = self.cfg["flatline_samples"] - 1
        stored = self.history.get()  # None for a new key
        past, last_us = (np.asarray(stored[0], dtype="float64"), int(stored[1])) if stored else (np.zeros(0), None)
        frames = list(rows)
        # the order of a batch's rows is known only when all of them are: times and ids are put in order, the rows follow chunk by chunk
        us_all = np.concatenate([f["phenomenon_time"].to_numpy().astype("datetime64[us]").astype("int64") for f in frames])
        order = np.lexsort((np.concatenate([f["id"].to_numpy() for f in frames]), us_all))
        ends = np.cumsum([len(f) for f in frames])
        for at in range(0, len(order), self.chunk_rows):
            own = order[at : at + self.chunk_rows]
            frame = np.searchsorted(ends, own, side="right")
            first = ends - np.array([len(f) for f in frames])
            parts = [(frames[k].iloc[own[frame == k] - first[k]], np.flatnonzero(frame == k)) for k in np.unique(frame)]
            place = np.concatenate([p for _, p in parts])
            chunk = pd.concat([f for f, _ in parts], ignore_index=True).iloc[np.argsort(place)]
            us = us_all[own]
            out = chunk[["id", "device_id", "observed_property", "phenomenon_time", "result_value"]].copy()
            out["quality"] = self._labels(key[1], chunk, us, past, last_us)
            past, last_us = np.concatenate([past, chunk["result_value"].to_numpy(dtype="float64")])[-need:], int(us[-1])
            yield out
        self.history.update((past.tolist(), last_us))
        if self.ttl_us is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last_us + self.ttl_us) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.history.clear()
        yield from ()

    def close(self) -> None:
        pass


QUALITY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("device_id", T.StringType()), T.StructField("observed_property", T.StringType()),
        T.StructField("phenomenon_time", T.TimestampType()), T.StructField("result_value", T.DoubleType()), T.StructField("quality", T.StringType()),
    ]
)


def stream_quality(obs: DataFrame, cfg: dict[str, Any] | None = None, ttl_hours: float | None = None, delay: str = "2 hours") -> DataFrame:
    """Quality labels on a stream; state is eleven numbers per device and property.

    With ``ttl_hours`` a device's state goes once the watermark, ``delay`` behind the
    newest row, has passed its last row by so much; a row after that is like a first one.
    Rows behind the watermark are dropped only then.
    """
    obs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    cols = ["id", F.col("device_id").cast("string").alias("device_id"), "observed_property", F.col("phenomenon_time").cast("timestamp").alias("phenomenon_time"), "result_value"]
    cols += ["bad_unit"] if "bad_unit" in obs.columns else []
    rows = obs.select(*cols)
    if ttl_hours is not None:
        rows = rows.withWatermark("phenomenon_time", delay)
    return rows.groupBy("device_id", "observed_property").transformWithStateInPandas(
        statefulProcessor=QualityState(cfg or PARAMS["sensor"], None if ttl_hours is None else int(ttl_hours * 3.6e9)),
        outputStructType=QUALITY_SCHEMA, outputMode="Append", timeMode="None" if ttl_hours is None else "EventTime",
    )


def hourly_rollup(labelled: DataFrame, delay: str = "2 hours", keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """Tumbling hours on event time, without rows behind the watermark; ``late.HourStore`` keeps those."""
    w = labelled.withWatermark("phenomenon_time", delay)
    return hourly_features(w, F.window("phenomenon_time", "1 hour")["start"], keys)


def windowed_rollup(labelled: DataFrame, delay: str = "2 hours", keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """Same aggregates with the window itself as grouping key, as append mode needs; drops rows behind the watermark too."""
    prop, v = F.col("observed_property"), F.col("result_value")
    of = lambda name: F.when(prop == name, v)
    ok = labelled.filter((F.col("quality") == "ok") & prop.isin("rainfall", "pore_pressure", "soil_moisture", "displacement"))
    days = F.when(prop == "displacement", F.unix_micros("phenomenon_time") % F.lit(3_600_000_000) / F.lit(8.64e10))
    agg = ok.withWatermark("phenomenon_time", delay).groupBy(*keys, F.window("phenomenon_time", "1 hour").alias("w")).agg(
        F.sum(of("rainfall")).alias("rainfall_mm"), F.avg(of("pore_pressure")).alias("pore_pressure_kpa"), F.avg(of("soil_moisture")).alias("soil_moisture"),
        F.max_by(of("displacement"), F.when(prop == "displacement", F.struct("phenomenon_time", "id"))).alias("displacement_mm"),
        F.when(F.count(of("displacement")) > 1, F.regr_slope(of("displacement"), days)).alias("velocity_mmd"),
        F.count(F.lit(1)).alias("sample_count"), F.max("phenomenon_time").alias("last_observation_at"),
    )
    return agg.select(*keys, F.col("w.start").alias("bucket"), *[c for c in agg.columns if c not in (*keys, "w")])


def antecedent_windows(rain: DataFrame, hours: int = 72, delay: str = "2 hours") -> DataFrame:
    """Sliding antecedent sums, one per full hour; rows behind the watermark are dropped (``late.HourStore.rain_windows`` keeps them)."""
    w = rain.withWatermark("ts", delay).groupBy("series_id", F.window("ts", f"{hours} hours", "1 hour").alias("w")).agg(F.sum("mm").alias("mm"), F.count(F.lit(1)).alias("n"))
    return w.select("series_id", F.col("w.end").alias("as_of"), "mm", "n")


def last_seen(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("device_id").agg(F.max("phenomenon_time").alias("last_seen_at"))


def recompute_hours(observations: DataFrame, touched: DataFrame) -> DataFrame:
    """Features of exactly the (device, hour) pairs a batch touched, however late its rows are."""
    hour = F.date_trunc("hour", "phenomenon_time")
    pairs = touched.select("device_id", hour.alias("_h")).distinct()
    rows = observations.withColumn("_h", hour).join(pairs, ["device_id", "_h"], "left_semi").drop("_h")
    return hourly_features(rows, F.date_trunc("hour", "phenomenon_time"))


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return the written rows.

    Output and checkpoint live in the shared folder; every micro-batch writes
    its own directory, so a retried batch replaces itself.
    """
    spark = stream.sparkSession
    base = shared_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/b{batch_id}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    finally:
        q.stop()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    if q.lastProgress is None:  # nothing arrived, so nothing was written
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/out/*")


def drain_latest(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """As ``drain`` for updating aggregates: the newest version of each key."""
    return latest_per_key(drain(stream, label, "update"), keys, ["batch_id"]).drop("batch_id")


def split_rejects(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    return enriched.filter(F.col("reject").isNull()), enriched.filter(F.col("reject").isNotNull())


def merge_latest(latest: DataFrame, batch: DataFrame, keys: Column | list[str], order: list[str]) -> DataFrame:
    """Latest-state table after one micro-batch."""
    return latest_per_key(latest.unionByName(batch.select(*latest.columns)), list(keys), order)
