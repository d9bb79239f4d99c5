"""As-of joins move each side once, and only what is read later."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from slopewatch.operators.asof import asof_join

START = datetime(2024, 1, 1)


def done(df) -> str:
    """The plan as it ran; what a reused shuffle repeats is not shown in it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def moved(plan: str, by: str) -> int:
    return sum(f"Exchange hashpartitioning({by}" in line and "ReusedExchange" not in line for line in plan.splitlines())


@pytest.fixture(scope="module")
def sides(spark):
    rnd = random.Random(11)
    at = lambda: START + timedelta(hours=rnd.randrange(700))
    left = [(i, rnd.choice(["a", "a", "b", None]), at() if i % 9 else None, f"wide{i}") for i in range(300)]
    right = [(i if i % 5 else None, rnd.choice(["a", "a", "c", None]), at() if i % 7 else None, rnd.choice([None, rnd.random()])) for i in range(200)]
    return left, right


@pytest.mark.parametrize("direction,tolerance,bucket,strict", [("nearest", 30, 48, False), ("nearest", 48, 48, False), ("nearest", 60, 48, False), ("backward", 30, 48, False), ("backward", 60, 48, True), ("backward", None, 48, False), ("nearest", None, 48, False)])
def test_rows_of_one_instant_and_nulls(spark, sides, direction, tolerance, bucket, strict):
    left, right = sides
    right = [(i, *r[1:]) for i, r in enumerate(right)]  # every row may win here
    l = spark.createDataFrame(left, "lid int, k string, t timestamp, wide string").repartition(3)
    r = spark.createDataFrame(right, "rid int, k string, rt timestamp, v double").repartition(4)
    how = {"tie": "rid", "strict": strict, "bucket_hours": bucket, "direction": direction, "tolerance_hours": tolerance}
    got = asof_join(l, r, ["k"], "t", "rt", ["rid", "v"], **how)
    assert got.columns == ["lid", "k", "t", "wide", "match"] and got.schema["match"].dataType.names == ["rt", "rid", "v"]
    got = {x["lid"]: tuple(x) for x in got.collect()}
    assert len(got) == len(left)
    for row in left:
        gap = {x: (row[2] - x[2]).total_seconds() / 3600 for x in right if row[2] and x[2] and x[1] == row[1]}
        fit = [x for x, g in gap.items() if (tolerance is None or abs(g) <= tolerance) and (direction == "nearest" or g > 0 or (g == 0 and not strict))]
        best = min(fit, key=lambda x: (abs(gap[x]), x[2], x[0]), default=None)
        if row[2] is not None:
            assert got[row[0]] == (*row, best and (best[2], best[0], best[3])), row
    flat = {x["lid"]: (x["v"], x["seen"]) for x in asof_join(l, r, ["k"], "t", "rt", ["rid", "v"], into={"v": "v", "rid": "seen"}, **how).collect()}
    assert flat == {i: (x[4][2], x[4][1]) if x[4] else (None, None) for i, x in got.items()}
    only = {x["lid"]: tuple(x) for x in asof_join(l, r, ["k"], "t", "rt", ["rid", "v"], inner=True, **how).collect()}
    assert only == {i: x for i, x in got.items() if x[4] and x[2]}


def test_the_last_of_the_bucket_before_is_carried_whatever_the_bucket(spark, sides):
    """A row without a tie value never wins."""
    l = spark.createDataFrame(sides[0], "lid int, k string, t timestamp, wide string")
    r = spark.createDataFrame([(x, k, t, v) for x, k, t, v in sides[1] if x is not None], "rid int, k string, rt timestamp, v double")
    rows = lambda df: sorted(map(str, df.collect()))
    for direction in ("backward", "nearest"):
        whole = rows(asof_join(l, r, ["k"], "t", "rt", ["rid", "v"], direction, 20, tie="rid", bucket_hours=5000))
        for bucket in (20, 33, 7):
            assert rows(asof_join(l, r, ["k"], "t", "rt", ["rid", "v"], direction, 20, tie="rid", bucket_hours=bucket)) == whole


def test_each_side_is_moved_once(spark, sides):
    l = spark.createDataFrame(sides[0], "lid int, k string, t timestamp, wide string")
    r = spark.createDataFrame(sides[1], "rid int, k string, rt timestamp, v double")
    for direction in ("backward", "nearest"):
        plan = done(asof_join(l, r, ["k"], "t", "rt", ["rid", "v"], direction, 30, tie="rid", bucket_hours=48))
        assert moved(plan, "k") == 3  # left, right, and a row per bucket for its neighbours
    slim = asof_join(l, r, ["k"], "t", "rt", ["rid", "v"], "backward", 30, tie="rid", bucket_hours=48).select("lid")
    assert all("Scan" in line for line in done(slim).splitlines() if "wide" in line)


def test_shadow_summary_reads_the_runs_once(spark, tmp_path):
    """Both passes of pip6_shadow_summary, pairs and truth table, need runs and assessments by cell and time."""
    rnd = random.Random(3)
    day = lambda d: START + timedelta(days=d)
    tables = {
        "customer": ([(i, f"c{i}", i % 4, 1.0, "BUILDING") for i in range(20)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(i, f"n{i}", i % 2) for i in range(4)], "n_nationkey int, n_name string, n_regionkey int"),
        "orders": ([(i, i % 20, "O", rnd.uniform(1e5, 5e5), day(rnd.randrange(400)), "1-URGENT") for i in range(200)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(i % 200, i // 200, float(rnd.randrange(1, 50)), day(rnd.randrange(400))) for i in range(600)], "l_orderkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = contract.queries()["pip6_shadow_summary"](spark, str(tmp_path))
    plan = done(out)
    assert sum("FileScan parquet [l_orderkey" in line for line in plan.splitlines()) == 1
    assert moved(plan, "cell_id") <= 7  # runs, assessments, events by both, and three times the rows for neighbours

    orders, lines = tables["orders"][0], tables["lineitem"][0]
    area = {i: f"aoi-{i % 4 % 2}" for i in range(20)}
    near = lambda a, b, days: abs((a - b).total_seconds()) <= days * 86400
    runs = [(k % 20, ts) for k, _, _, ts in lines]
    want = {a: [0, 0, 0] for a in ("aoi-0", "aoi-1")}
    for c, ts in runs:
        want[area[c]][0] += any(near(o[4], ts, 30) for o in orders if o[1] == c)
    for o in orders:
        if o[3] >= 330000:
            at = o[4] + timedelta(days=o[0] % 40 + 1)
            back = lambda ts: ts <= at and near(ts, at, 60)
            want[area[o[1]]][1] += 1
            want[area[o[1]]][2] += any(back(p[4]) for p in orders if p[1] == o[1]) and any(back(ts) for c, ts in runs if c == o[1])
    assert {x["aoi_id"]: [x["pairs"], x["events"], x["both_seen"]] for x in out.collect()} == want
