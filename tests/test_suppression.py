"""Dispatched alerts against the walk by definition, with one key that never pauses."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slopewatch.streaming.alerts import suppress_batch, successors

START = datetime(2024, 1, 1)


def walked(rows, minutes):
    out, last = set(), {}
    for key, ts in sorted(set(rows), key=lambda r: (str(r[0]), r[1])):
        if key not in last or ts - last[key] > timedelta(minutes=minutes):
            last[key] = ts
            out.add((key, ts))
    return out


@pytest.mark.parametrize("block_rows", [3, 50, 100_000])
def test_equals_the_walk(spark, block_rows):
    rnd = random.Random(block_rows)
    rows = [(rnd.choice(["a", "b", None, "c"]), START + timedelta(minutes=rnd.choice([rnd.randrange(4000), 5 * rnd.randrange(700)]))) for _ in range(700)]
    rows += [("hot", START + timedelta(minutes=k)) for k in range(400)]  # a third of all, a minute apart
    rows += [("once", START), ("once", START)]
    table = spark.createDataFrame(rows, "k string, ts timestamp").repartition(5)
    for minutes in (5, 45, 100_000):
        got = {(r["k"], r["ts"]) for r in suppress_batch(table, "k", minutes, slice_hours=6.0, block_rows=block_rows).collect()}
        assert got == walked(rows, minutes), minutes


def test_no_group_is_larger_than_a_block(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    times = rows.select("k", F.unix_micros("ts").alias("us"))
    got = successors(times, "k", 10 * 60_000_000, 24.0)
    assert got.filter("succ != seq + 11").count() == 0 and got.filter("succ is null").count() == 11
    sent = suppress_batch(rows, "k", 10, slice_hours=24.0, block_rows=500)
    assert sent.count() == -(-30_000 // 11) and sent.filter("(us div 60000000) % 11 != 0").count() == 0


def test_nothing(spark):
    assert suppress_batch(spark.createDataFrame([], "k long, ts timestamp"), "k", 5).count() == 0
