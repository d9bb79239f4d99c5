"""Polygons cut into pieces against plain ray casting and plain edge tests."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from slopewatch.operators import spatial as X
from slopewatch.operators.pieces import MOST, inside_pieces, polygon_pieces

EDGES = "geom_id int, x1 double, y1 double, x2 double, y2 double"


def ring(geom, points):
    return [(geom, *points[i], *points[(i + 1) % len(points)]) for i in range(len(points))]


def star(geom, cx, cy, r, n, rnd):
    return ring(geom, [(cx + r * rnd.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), cy + r * rnd.uniform(0.2, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)])


def parity(x, y, edges):
    _, x1, y1, x2, y2 = (np.array(c) for c in zip(*edges))
    with np.errstate(divide="ignore", invalid="ignore"):
        return int((((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) / (y2 - y1) * (x2 - x1))).sum()) % 2 == 1


@pytest.fixture(scope="module")
def shapes():
    rnd = random.Random(5)
    out = {1: star(1, 10.0, 45.0, 0.5, 60, rnd), 2: star(2, 10.3, 45.1, 0.2, 9, rnd), 3: star(3, 10.0, 45.0, 0.02, 40, rnd)}
    out[4] = ring(4, [(9.6, 44.6), (10.4, 44.6), (10.4, 45.4), (9.6, 45.4)]) + ring(4, [(9.8, 44.8), (9.8, 45.2), (10.2, 45.2), (10.2, 44.8)])  # with a hole
    out[5] = [e for k in range(30) for e in ring(5, [(10.1, 45.1), (10.1 + 0.1 * math.cos(k / 5), 45.1 + 0.1 * math.sin(k / 5)), (10.1 + 0.1 * math.cos(k / 5 + 0.1), 45.1 + 0.1 * math.sin(k / 5 + 0.1))])]  # meet in one point
    return out


@pytest.mark.parametrize("most", [2, 7, MOST])
def test_points_in_pieces(spark, shapes, most):
    rnd = random.Random(6)
    every = [e for edges in shapes.values() for e in edges]
    edges = spark.createDataFrame(every, EDGES)
    points = [(rnd.choice([round(rnd.uniform(9.5, 10.5), 2), rnd.uniform(9.5, 10.5)]), rnd.choice([round(rnd.uniform(44.5, 45.5), 2), rnd.uniform(44.5, 45.5)])) for _ in range(600)]
    cut = polygon_pieces(edges, most=most, deepest=5)
    cand = X.box_candidates(spark.createDataFrame(sorted(set(points)), "x double, y double"), X.ring_boxes(edges), 0.05)
    got = {(r["x"], r["y"], r["geom_id"]) for r in inside_pieces(cand, cut).collect()}
    on_line = lambda x, y, g: g == 4 and (x in (9.6, 9.8, 10.2, 10.4) or y in (44.6, 44.8, 45.2, 45.4))
    want = {(x, y, g) for x, y in set(points) for g, es in shapes.items() if parity(x, y, es) and not on_line(x, y, g)}
    assert {k for k in got if not on_line(*k)} == want


def test_squares_touching_pieces(spark, shapes, monkeypatch):
    edges = spark.createDataFrame([e for es in shapes.values() for e in es], EDGES)
    cells = [(k, round(9.4 + 0.03 * (k % 40), 6) + 0.0001, round(44.4 + 0.03 * (k // 40), 6) + 0.0001) for k in range(1600)]
    table = spark.createDataFrame(cells, "cell_id int, lon double, lat double")

    def meets(lon, lat, e, half=0.005):
        (ax, ay, bx, by) = (e[1] - lon, e[2] - lat, e[3] - lon, e[4] - lat)
        nx, ny = by - ay, ax - bx
        return min(ax, bx) <= half and max(ax, bx) >= -half and min(ay, by) <= half and max(ay, by) >= -half and abs(nx * ax + ny * ay) <= half * (abs(nx) + abs(ny))

    want = {(k, g) for k, lon, lat in cells for g, es in shapes.items() if any(meets(lon, lat, e) for e in es) or parity(lon, lat, es)}
    for most in (3, MOST):
        monkeypatch.setattr(X, "polygon_pieces", lambda e, g, most=most: polygon_pieces(e, g, most=most, deepest=4))
        assert {(r["cell_id"], r["geom_id"]) for r in X.polygons_touching_cells(table, edges).collect()} == want


def test_one_polygon_of_a_hundred_thousand_edges(spark):
    n = 100_000
    turn = np.arange(n) * 2 * math.pi / n
    r = 2 + 0.1 * np.sin(300 * turn) + 0.002 * np.sin(20_011 * turn)
    x, y = 12 + r * np.cos(turn), 42 + r * np.sin(turn)
    frame = pd.DataFrame({"geom_id": 1, "x1": x, "y1": y, "x2": np.roll(x, -1), "y2": np.roll(y, -1)})
    edges = spark.createDataFrame(frame, EDGES)
    cut = polygon_pieces(edges)
    pieces, rims = cut.pieces.cache(), cut.rims.cache()
    sizes = rims.groupBy("geom_id", "level", "qx", "qy").count().toPandas()["count"]
    assert sizes.max() <= MOST and len(sizes) > 1000 and rims.count() < 2 * n
    assert pieces.filter("n = 0").count() > 500  # inside as a whole
    rng = np.random.default_rng(1)
    px, py = rng.uniform(9.7, 14.3, 4000), rng.uniform(39.7, 44.3, 4000)
    points = spark.createDataFrame(pd.DataFrame({"point_id": range(4000), "x": px, "y": py}))
    got = {row[0] for row in X.points_in_polygons(points, edges, cut=cut).select("point_id").collect()}
    own = list(zip(*[frame[c] for c in EDGES.replace(",", "").split()[::2]]))
    for k in range(0, 4000, 8):
        assert (k in got) == parity(px[k], py[k], own), (px[k], py[k])
