"""Alert suppression and triggers: keyed state on streams, successor chains in batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slopewatch.operators.running import sliced_running
from slopewatch.session import ROCKSDB_PROVIDER, cut_lineage


def greedy_dispatch(us: pd.Series, window_us: int, last_us: int | None = None) -> list[bool]:
    """Which of the ascending times are dispatched: those past the window of the last *dispatched* one."""
    out = []
    for t in us.tolist():
        send = last_us is None or t - last_us > window_us
        last_us = t if send else last_us
        out.append(send)
    return out


class Suppress(StatefulProcessor):
    """Per key the time of the last dispatched row; later rows inside the window are dropped."""

    def __init__(self, window_us: int, columns: Sequence[str]) -> None:
        self.window_us, self.columns = window_us, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "id"], kind="stable", ignore_index=True)
        us = batch["ts"].astype("datetime64[us]").astype("int64")
        before = self.last.get()[0] if self.last.exists() else None
        send = pd.Series(greedy_dispatch(us, self.window_us, before), index=batch.index)
        if send.any():
            self.last.update((int(us[send].iloc[-1]),))
        yield batch.loc[send, self.columns]

    def close(self) -> None:
        pass


def suppress_stream(alerts: DataFrame, key: str, minutes: int) -> DataFrame:
    """Stream form; ``alerts(key, ts, id)``. The same job serves cells, areas and forecast horizons."""
    alerts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    rows = alerts.select(F.col(key).cast("string").alias(key), F.col("ts").cast("timestamp").alias("ts"), "id")
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("id", T.LongType())])
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Suppress(minutes * 60_000_000, [key, "ts", "id"]), outputStructType=schema, outputMode="Append", timeMode="None"
    )


def _whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames cut so that no (key, block) group crosses a border; rows come ordered by them."""
    rest = None
    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        same = (pdf["block"] == pdf["block"].iloc[-1]).to_numpy() & ((pdf[key] == pdf[key].iloc[-1]) | (pdf[key].isna() & pd.isna(pdf[key].iloc[-1]))).to_numpy()
        head = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        rest = pdf.iloc[head:]
        if head:
            yield pdf.iloc[:head].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def _next_in_block(pdf: pd.DataFrame, block_rows: int) -> np.ndarray:
    """Row number of each row's successor, -1 where that lies in another block."""
    seq, succ, block = (pdf[c].to_numpy() for c in ("seq", "succ", "block"))
    return np.where((succ - 1) // block_rows == block, np.arange(len(pdf)) + succ - seq, -1)


def successors(times: DataFrame, key: str, window_us: int, slice_hours: float) -> DataFrame:
    """(key, us, seq, succ) of distinct times: number in the key's order, and that of the first time beyond the window.

    ``succ`` is null where there is none. Times and window ends share one running
    count in time slices, so no key is ordered in one task.
    """
    ends = times.select(key, "us", (F.col("us") + window_us).alias("at"), F.lit(0).alias("is_time"))
    both = times.select(key, "us", F.col("us").alias("at"), F.lit(1).alias("is_time")).unionByName(ends)
    both = both.withColumn("_slice", F.floor(F.col("at") / int(slice_hours * 3_600_000_000)))
    counted = sliced_running(both, [key], "_slice", ["at", F.desc("is_time")], sums={"n": F.col("is_time").cast("bigint")})
    pairs = counted.groupBy(key, "us").agg(F.max(F.when(F.col("is_time") == 1, F.col("n"))).alias("seq"), (F.max(F.when(F.col("is_time") == 0, F.col("n"))) + 1).alias("succ"))
    totals = times.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    same = F.col(f"p.{key}").eqNullSafe(F.col(f"t.{key}"))
    joined = pairs.alias("p").join(totals.alias("t"), same).select("p.*", "t.total")
    return joined.withColumn("succ", F.when(F.col("succ") <= F.col("total"), F.col("succ")))


def _entries(nodes: DataFrame, key: str, kind: str, block_rows: int) -> DataFrame:
    """(key, seq): where the chain from each key's first time enters blocks.

    Every row's way out of its block is found inside the block; what is entered
    that way makes a short chain over blocks, which pointer doubling follows.
    """

    def leave(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(frames, key):
            succ = pdf["succ"].to_numpy().copy()
            nxt = _next_in_block(pdf, block_rows)
            while (inner := np.flatnonzero(nxt >= 0)).size:
                succ[inner], nxt[inner] = succ[nxt[inner]], nxt[nxt[inner]]
            yield pd.DataFrame({key: pdf[key], "seq": pdf["seq"], "out": succ})

    ways = nodes.select(key, "block", "seq", F.coalesce("succ", F.lit(-1)).alias("succ"))
    ways = ways.repartition(key, "block").sortWithinPartitions(key, "block", "seq").mapInPandas(leave, f"{key} {kind}, seq bigint, out bigint")
    ways = cut_lineage(ways)
    entered = ways.filter("out > 0").select(key, F.col("out").alias("seq")).distinct()
    first = nodes.filter("seq = 1").select(key, "seq")
    on = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    hops = cut_lineage(entered.unionByName(first).distinct().alias("a").join(ways.alias("b"), on & (F.col("a.seq") == F.col("b.seq"))).filter("out > 0").select(f"a.{key}", "a.seq", "b.out"))
    reached = first
    most = nodes.agg(F.max("block")).first()[0] or 0
    for _ in range(int(most).bit_length()):  # chains over blocks are no longer than blocks
        on_way = reached.alias("a").join(hops.alias("b"), on & (F.col("a.seq") == F.col("b.seq"))).select(f"a.{key}", F.col("b.out").alias("seq"))
        reached = cut_lineage(reached.unionByName(on_way).distinct())
        hops = cut_lineage(hops.alias("a").join(hops.alias("b"), on & (F.col("a.out") == F.col("b.seq"))).select(f"a.{key}", "a.seq", "b.out"))
    return reached


def suppress_batch(alerts: DataFrame, key: str, minutes: float, slice_hours: float = 720.0, block_rows: int = 100_000) -> DataFrame:
    """Batch twin: (key, us, ts) of the dispatched rows.

    Each time points to the first one beyond its window; the dispatched times are
    the chain from a key's first. Keys are cut into blocks of ``block_rows``
    times: a block is walked from where the chain enters it, and only keys of several
    blocks need to find out where that is. A key without any pause is as many tasks as it has blocks.
    """
    times = alerts.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).distinct()
    kind = dict(times.dtypes)[key]
    nodes = successors(times, key, int(minutes * 60_000_000), slice_hours).withColumn("block", F.floor((F.col("seq") - 1) / block_rows))
    nodes = cut_lineage(nodes)
    large = nodes.filter(F.col("total") > block_rows)
    entry = F.col("seq") == 1
    if not large.isEmpty():
        found = _entries(large, key, kind, block_rows).withColumn("_e", F.lit(True))
        same = F.col(f"n.{key}").eqNullSafe(F.col(f"e.{key}")) & (F.col("n.seq") == F.col("e.seq"))
        nodes = nodes.alias("n").join(found.alias("e"), same, "left").select("n.*", "e._e")
        entry = entry | F.coalesce("_e", F.lit(False))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(frames, key):
            nxt, keep = _next_in_block(pdf, block_rows), np.zeros(len(pdf), bool)
            at = np.flatnonzero(pdf["entry"].to_numpy())
            while at.size:  # all groups at once, a step each
                keep[at] = True
                at = nxt[at]
                at = at[at >= 0]
            yield pdf.loc[keep, [key, "us"]]

    rows = nodes.select(key, "block", "seq", F.coalesce("succ", F.lit(-1)).alias("succ"), "us", entry.alias("entry"))
    sent = rows.repartition(key, "block").sortWithinPartitions(key, "block", "seq").mapInPandas(walk, f"{key} {kind}, us bigint")
    return sent.withColumn("ts", F.timestamp_micros("us"))


def not_recently_sent(candidates: DataFrame, ledger: DataFrame, key: str, as_of: Any, minutes: int) -> DataFrame:
    """One run against the ledger: candidates whose key was not dispatched inside the window."""
    recent = ledger.filter(F.col("ts") >= as_of - F.make_dt_interval(mins=F.lit(minutes))).select(key)
    return candidates.join(recent, key, "left_anti")


def nowcast_triggers(peaks: DataFrame, min_mm_h: float, min_pixels: int) -> DataFrame:
    """Areas whose radar peak and hot-pixel count call for a run."""
    return peaks.filter((F.col("peak") >= min_mm_h) & (F.col("hot_pixels") >= min_pixels))


