"""The hourly replay against every window taken by itself."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from slopewatch.functions.basic import at_least
from slopewatch.functions.scoring import rain_excess, score
from slopewatch.operators.evaluation import backtest_scores
from slopewatch.plans import offline
from slopewatch.plans.offline import alert_hours, node_hours
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def window(samples, t, hours):
    """(rain of 24 hours, event total, event hours) of the samples in one trailing window."""
    own = sorted((ts, mm) for ts, mm in samples if t - timedelta(hours=hours) <= ts <= t)
    if not own:
        return None
    day = [mm for ts, mm in own if ts >= t - timedelta(hours=24)]
    best, event, dry = (None, None), [], 0
    for ts, mm in [*own, (None, 0.0)]:
        dry = dry + 1 if mm <= 0 else 0
        if mm > 0:
            event.append((ts, mm))
        if event and (dry >= 6 or ts is None):
            total = sum(m for _, m in event)
            if total >= 2.0 - 1e-9:
                best = (total, max(1.0, (event[-1][0] - event[0][0]).total_seconds() / 3600 + 1))
            event = []
    return (sum(day) if day else None, *best)


@pytest.mark.parametrize(("hours", "slice_hours"), [(48, 720.0), (25, 24.0), (30, 7.0)])
def test_node_hours_equal_every_window(spark, hours, slice_hours):
    rnd = random.Random(hours)
    series = {"hot": [(START + timedelta(hours=h), rnd.choice([0.0, 0.0, 0.25, 1.75])) for h in range(220)]}
    for node in ("a", "b", "c"):
        at = sorted(rnd.sample(range(220), rnd.choice([2, 30, 60])))
        series[node] = [(START + timedelta(hours=h), rnd.choice([0.0, 0.0, 0.0, 0.5, 2.0, 5.25])) for h in at]
    rows = [(n, ts, mm) for n, s in series.items() for ts, mm in s]
    rain = spark.createDataFrame(rows, "node_id string, ts timestamp, mm double").repartition(5)
    hours_of = [START + timedelta(hours=h) for h in range(-3, 230, 2)]
    got = {(r["node_id"], r["t"]): r for r in node_hours(rain, spark.createDataFrame([(t,) for t in hours_of], "t timestamp"), hours, slice_hours=slice_hours).collect()}
    number = lambda v: None if v is None else round(v, 6)
    for node, samples in series.items():
        for t in hours_of:
            want, row = window(samples, t, hours), got.pop((node, t), None)
            assert (want is None) == (row is None), (node, t)
            if want:
                assert tuple(map(number, (row["rain_24h_mm"], row["event_mm"], row["event_hours"]))) == tuple(map(number, want)), (node, t)
    assert not got


def test_alert_rows_may_stand_for_several(spark):
    alerts = spark.createDataFrame([(1, START, 3), (1, START + timedelta(hours=9), 2), (2, START, 1)], "cell_id int, ts timestamp, hours int")
    truth = spark.createDataFrame([(1, START + timedelta(hours=20)), (3, START)], "cell_id int, event_time timestamp")
    got = backtest_scores(alerts, truth, times=F.col("hours")).first()
    assert (got["alerts"], got["alerted_cells"], got["hits"], got["misses"], got["mean_lead_h"]) == (6, 2, 1, 1, 20.0)


def test_only_samples_are_moved_and_once(spark):
    rain = spark.createDataFrame([("a", START + timedelta(hours=h), 1.0) for h in range(9)], "node_id string, ts timestamp, mm double")
    axis = spark.createDataFrame([(START + timedelta(hours=h),) for h in range(200)], "t timestamp")
    got = node_hours(rain, axis)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(node_id") == 1
    assert "Generate explode(sequence" in plan.partition("Exchange hashpartitioning(node_id")[0]  # hours come in after it
    assert got.count() == 9 + 48


def test_odd_samples(spark):
    series = {"a": [(START + timedelta(hours=h), mm) for h, mm in ((0, 3.0), (5, 0.0), (30, 1.5), (31, 0.5), (100, 0.0))], None: [(START + timedelta(hours=2), 4.0)]}
    rows = [(n, ts, mm) for n, s in series.items() for ts, mm in s] + [("a", None, 50.0), ("a", None, None), ("dateless", None, 9.0)]
    rain = spark.createDataFrame(rows, "node_id string, ts timestamp, mm double")
    hours_of = [START + timedelta(hours=h) for h in range(-2, 160)]
    axis = spark.createDataFrame([(t,) for t in [*hours_of, START, None]], "t timestamp")
    for slice_hours in (720.0, 10.0):
        got = {(r["node_id"], r["t"]): tuple(r)[2:] for r in node_hours(rain, axis, slice_hours=slice_hours).collect()}
        want = {(n, t): window(s, t, 48) for n, s in series.items() for t in hours_of}
        assert got == {k: v for k, v in want.items() if v}


def test_no_rain(spark):
    rain = spark.createDataFrame([], "node_id string, ts timestamp, mm double")
    assert node_hours(rain, spark.createDataFrame([(START,)], "t timestamp")).count() == 0


def test_halving_finds_what_every_pair_gives(spark):
    rnd = random.Random(5)
    columns = ["susc_ispra", "slope_deg", "pai_class_norm", "sensor_rainfall_mm", "velocity_mmd"]
    value = lambda c: rnd.choice([None, rnd.random() * {"slope_deg": 45, "velocity_mmd": 30, "sensor_rainfall_mm": 4}.get(c, 1)])
    static = spark.createDataFrame([(i % 55, *[value(c) for c in columns]) for i in range(60)], "cell_id int, " + ", ".join(f"{c} double" for c in columns))  # five ids twice
    nodes = [*"abcde", None]
    cells = spark.createDataFrame([(i % 57 if i < 59 else None, nodes[i % 6]) for i in range(60)], "cell_id int, node_id string")
    states = [(n, rnd.choice([0.0, rnd.random() * 2]), START + timedelta(hours=rnd.randrange(500)), rnd.randint(1, 9)) for n in "abcdx" for _ in range(rnd.choice([1, 6, 33]))]
    states = spark.createDataFrame(states, "node_id string, caine_excess double, ts timestamp, hours long")
    placed = cells.join(static, "cell_id")
    for minimum in ("Low", "Moderate"):
        whole = score(placed.join(states, "node_id")).filter(at_least("level", minimum)).groupBy("cell_id").agg(F.min("ts"), F.sum("hours"))
        got = alert_hours(placed, states, minimum).groupBy("cell_id").agg(F.min("ts"), F.sum("hours"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())), minimum


def test_a_backtest_scores_a_cell_once_per_bit(spark, monkeypatch):
    rain = spark.createDataFrame([(n, START + timedelta(hours=h), float(h % 13)) for n in ("a", "empty") for h in range(0, 300, 2)], "node_id string, ts timestamp, mm double")
    axis = spark.createDataFrame([(START + timedelta(hours=h),) for h in range(300)], "t timestamp")
    cells = spark.range(40).selectExpr("id as cell_id", "'a' as node_id")
    static = spark.range(40).selectExpr("id as cell_id", "id / 40D as susc_ispra", "id / 1D as slope_deg")
    truth = spark.createDataFrame([(3, START + timedelta(hours=90))], "cell_id long, event_time timestamp")
    met, asked = [], []
    monkeypatch.setattr(offline, "score", lambda df, p: met.append(df) or score(df, p))
    monkeypatch.setattr(offline, "node_hours", lambda r, *a, **b: asked.extend(x[0] for x in r.select("node_id").distinct().collect()) or node_hours(r, *a, **b))
    got = offline.backtest(cells, static, rain, axis, truth, minimum="Low").first()
    assert asked == ["a"] and 1 < len(met) <= 9 and met[-1].count() == 40
    states = node_hours(rain, axis).filter("node_id = 'a'").withColumn("caine_excess", rain_excess(F.col("event_mm"), F.col("event_hours"), F.lit("italy_default")))
    every = score(cells.join(static, "cell_id").join(states, "node_id")).filter(at_least("level", "Low"))
    assert (got["alerts"], got["alerted_cells"]) == (every.count(), every.select("cell_id").distinct().count()) and got["alerts"] > 0
