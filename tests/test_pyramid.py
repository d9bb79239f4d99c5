"""Counts, existence and nearest features on tiles against all pairs, with a crowded tile."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from slopewatch.operators import pyramid as P
from slopewatch.operators import spatial as X
from slopewatch.operators.segments import candidates, nearest_segment, segment_tiles


def metres(lon1, lat1, lon2, lat2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1.0, a)))


def places(n, rnd, crowd):
    """A third of all within some metres, some at one spot, the rest far and wide."""
    out = [(11.003 + rnd.uniform(0, 1e-4), 44.001 + rnd.uniform(0, 1e-4)) for _ in range(n // 3)] if crowd else []
    out += [(11.0, 44.0)] * 20 + [(round(rnd.uniform(10.9, 11.1), 3), round(rnd.uniform(43.9, 44.1), 3)) for _ in range(n // 3)]
    return out + [(rnd.uniform(10.5, 11.5), rnd.uniform(43.5, 44.5)) for _ in range(n - len(out))]


@pytest.mark.parametrize("most", [1, P.MOST])
def test_counts_equal_all_pairs(spark, most):
    rnd = random.Random(most)
    features, cells = places(900, rnd, True), [(k, 10.9 + 0.01 * (k % 20), 43.95 + 0.01 * (k // 20)) for k in range(200)]
    f, c = spark.createDataFrame(features, "x double, y double"), spark.createDataFrame(cells, "cell_id int, lon double, lat double")
    gap = lambda a, b: max(0.0, abs(a - b) - 0.005)
    reach = 0.0123
    square = P.count_in_reach(c, f, reach, P.square_degrees(0.005, reach), 4 * reach, most=most)
    want = {k: sum(math.hypot(gap(x, lon), gap(y, lat)) <= reach for x, y in features) for k, lon, lat in cells}
    assert {r["cell_id"]: r["n"] for r in square.collect()} == {k: n for k, n in want.items() if n}
    round_ = P.count_in_reach(c, f, 1500.0, P.great_circle(1500.0), 4 * 1500 / 110_000, most=most)
    want = {k: sum(metres(lon, lat, x, y) <= 1500 for x, y in features) for k, lon, lat in cells}
    assert {r["cell_id"]: r["n"] for r in round_.collect()} == {k: n for k, n in want.items() if n}


def test_a_crowded_tile_makes_few_pairs(spark):
    rnd = random.Random(9)
    crowd = [(11.0 + rnd.uniform(0, 0.02), 44.0 + rnd.uniform(0, 0.02)) for _ in range(30_000)]
    f = spark.createDataFrame(crowd, "x double, y double")
    cells = spark.createDataFrame([(k, 11.0 + 0.001 * (k % 20), 44.0 + 0.001 * (k // 20)) for k in range(400)], "cell_id int, lon double, lat double")
    measure, reach = P.great_circle(1000.0), 1000.0
    p = P.Pyramid(f, 4 * reach / 110_000)
    rows = p.start(cells, measure).select("cell_id", "lon", "lat", "level", "tx", "ty", "n", "leaf")
    side = p.side(F.col("level"))
    lower, upper = measure.bounds(F.col("tx") * side, F.col("ty") * side, side)
    for level in range(P.LEVELS):
        rows = rows.filter(lower <= reach)
        if level < P.LEVELS - 1:
            rows = p.open(rows, level, ["cell_id", "lon", "lat"], (F.col("level") == level) & ~F.col("leaf") & ~(upper <= reach))
    compared = rows.filter(~(upper <= reach)).join(p.spots, ["level", "tx", "ty"]).count()
    summed = rows.filter(upper <= reach).agg(F.sum("n")).first()[0]
    total = X.count_within_m(cells, f, reach).agg(F.sum("n")).first()[0]
    assert total > 3_000_000 and summed > 0.6 * total and compared < 0.25 * 400 * 30_000
    assert p.tiles.filter("leaf and spots > 32 and level < 5").count() == 0


def test_counts_of_nothing(spark):
    none = spark.createDataFrame([], "x double, y double")
    c = spark.createDataFrame([(1, 11.0, 44.0), (2, None, 44.0)], "cell_id int, lon double, lat double")
    assert {(r["cell_id"], r["n"]) for r in X.count_within(c, none, 0.01).collect()} == {(1, 0), (2, 0)}
    some = spark.createDataFrame([(11.0, 44.0), (None, 44.0)], "x double, y double")
    assert {(r["cell_id"], r["n"]) for r in X.count_within(c, some, 0.01).collect()} == {(1, 1), (2, 0)}


@pytest.mark.parametrize("most", [1, P.MOST])
def test_least_distance_by_group(spark, most):
    rnd = random.Random(4)
    members = [(rnd.choice("abc") if k % 3 else "hot", x, y) for k, (x, y) in enumerate(places(600, rnd, True))]
    events = [(k, rnd.uniform(10.9, 11.1), rnd.uniform(43.9, 44.1)) for k in range(150)] + [(200, 11.003, 44.001)]
    m, e = spark.createDataFrame(members, "zone string, x double, y double"), spark.createDataFrame(events, "event_id int, lon double, lat double")
    got = P.nearest_by_group(e, m, "zone", 3000.0, P.great_circle(3000.0), 4 * 3000 / 110_000, "event_id", most=most)
    want = {}
    for k, lon, lat in events:
        for z, x, y in members:
            d = metres(lon, lat, x, y)
            if d <= 3000:
                want[k, z] = min(d, want.get((k, z), 1e9))
    assert {(r["event_id"], r["zone"]): round(r["dist"], 4) for r in got.collect()} == {k: round(d, 4) for k, d in want.items()}


def faults(rnd, n):
    out = []
    for k in range(n):
        x, y = (11.0 + rnd.uniform(0, 0.01), 44.0 + rnd.uniform(0, 0.01)) if k % 3 == 0 else (rnd.uniform(10, 12), rnd.uniform(43, 45))
        reach = rnd.choice([0.0005, 0.0005, 0.05, 1.5])
        out.append((x, y, x + rnd.uniform(-reach, reach), y + rnd.uniform(-reach, reach)))
    return out + [(11.5, 44.5, 11.5, 44.5)] + out[:5]


def closest(lon, lat, line):
    x1, y1, x2, y2 = line
    dx, dy = x2 - x1, y2 - y1
    t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((lon - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy)))
    return metres(lon, lat, x1 + t * dx, y1 + t * dy)


@pytest.mark.parametrize(("n", "most"), [(3, 16), (300, 1), (300, 16)])
def test_nearest_segment_equals_all_pairs(spark, n, most):
    rnd = random.Random(n)
    lines, cells = faults(rnd, n), [(k, rnd.uniform(9.5, 12.5), rnd.uniform(42.5, 45.5)) for k in range(150)] + [(900 + k, 11.0 + 0.002 * k, 44.0) for k in range(6)]
    s, c = spark.createDataFrame(lines, "x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(cells, "cell_id int, lon double, lat double")
    in_box = lambda l, lon, lat: min(l[0], l[2]) <= lon + 0.5 and max(l[0], l[2]) >= lon - 0.5 and min(l[1], l[3]) <= lat + 0.5 and max(l[1], l[3]) >= lat - 0.5
    want = {k: round(min([closest(lon, lat, l) for l in lines if in_box(l, lon, lat)] + [50_000.0]), 3) for k, lon, lat in cells}
    assert {r["cell_id"]: round(r["dist_m"], 3) for r in nearest_segment(c, s, most=most).collect()} == want


def test_crowded_faults_make_few_candidates(spark):
    rnd = random.Random(5)
    lines = [(x, y, x + rnd.uniform(-2e-4, 2e-4), y + rnd.uniform(-2e-4, 2e-4)) for x, y in ((11 + rnd.uniform(0, 0.05), 44 + rnd.uniform(0, 0.05)) for _ in range(20_000))]
    s = spark.createDataFrame(lines, "x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([(k, 11 + 0.0025 * (k % 20), 44 + 0.0025 * (k // 20)) for k in range(400)], "cell_id int, lon double, lat double")
    tiles, _, _ = segment_tiles(s)
    assert tiles.filter("leaf and n > 16 and level < 5").count() == 0
    per_cell = candidates(cells, s).groupBy("cell_id").count().agg(F.max("count"), F.avg("count")).first()
    assert per_cell[0] < 400 and per_cell[1] < 150  # of 20,000
