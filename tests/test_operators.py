"""Operators against plain Python on small random fixtures."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slopewatch.operators import components as C
from slopewatch.operators import evaluation as E
from slopewatch.operators import learning as L
from slopewatch.operators import relational as R
from slopewatch.operators import sensors as N
from slopewatch.operators import spatial as X
from slopewatch.operators import timeseries as T
from slopewatch.operators import zonal as Z
from slopewatch.operators.asof import asof_join
from slopewatch.operators.running import cumulative_by_value, exact_percentiles, numbered, time_slice
from slopewatch.streaming.alerts import greedy_dispatch, suppress_batch

T0 = datetime(2024, 1, 1)


def series(n_keys=4, n=160, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n_keys):
        t = T0
        for _ in range(n):
            t += timedelta(hours=rnd.choice([1, 1, 1, 2, 9]))
            rows.append((k, t, rnd.choice([0.0, 0.0, 0.0, 0.5, 3.0])))
    return pd.DataFrame(rows, columns=["series_id", "ts", "mm"])


def events_by_hand(mm, ts, gap=6, least=2.0):
    out, start, total, last, dry = [], None, 0.0, None, 0

    def close():
        if start is not None and total >= least:
            out.append((round(total, 6), max(1.0, (ts[last] - ts[start]).total_seconds() / 3600 + 1)))

    for i, v in enumerate(mm):
        if v > 0:
            start = i if start is None else start
            total, last, dry = total + v, i, 0
        else:
            dry += 1
            if dry >= gap and start is not None:
                close()
                start, total = None, 0.0
    close()
    return out


def test_rain_events_match_a_plain_walk(spark):
    pdf = series()
    got = T.rain_events(spark.createDataFrame(pdf), slice_hours=48).toPandas().sort_values(["series_id", "end_seq"])
    for key, part in pdf.groupby("series_id"):
        want = events_by_hand(part["mm"].tolist(), part["ts"].tolist())
        mine = got[got.series_id == key]
        assert [(round(a, 6), b) for a, b in zip(mine.total_mm, mine.duration_h)] == want


def test_antecedent_index_known_answer(spark):
    df = spark.createDataFrame([(1, T0.date() + timedelta(days=i), v) for i, v in enumerate([10.0, 20.0, 5.0])], "series_id int, day date, mm double")
    assert T.antecedent_index(df, 0.9).first().api_mm == pytest.approx(31.1)
    with pytest.raises(Exception, match="negative"):
        T.antecedent_index(df.withColumn("mm", F.lit(-1.0))).collect()


def test_antecedent_windows_are_inclusive(spark):
    at = T0 + timedelta(days=40)
    pts = spark.createDataFrame([(1, at), (2, at)], "node_id int, as_of timestamp_ntz")
    rain = spark.createDataFrame([(1, at, 1.0), (1, at - timedelta(hours=24), 2.0), (1, at - timedelta(hours=72), 4.0), (1, at - timedelta(days=30), 8.0), (1, at - timedelta(days=30, seconds=1), 16.0), (1, at + timedelta(seconds=1), 32.0)], "node_id int, ts timestamp_ntz, mm double")
    rows = {r.node_id: r for r in T.antecedent_rain(pts, rain).collect()}
    assert (rows[1].rain_24h_mm, rows[1].rain_72h_mm, rows[1].rain_30d_mm, rows[1].max_i_24h_mmh, rows[1].degraded) == (3.0, 7.0, 15.0, 2.0, False)
    assert rows[2].degraded and rows[2].rain_30d_mm == 0.0


@pytest.mark.parametrize("direction,tolerance", [("backward", None), ("backward", 30), ("nearest", 12)])
def test_asof_against_brute_force(spark, direction, tolerance):
    rnd = random.Random(7)
    left = pd.DataFrame([(i, rnd.choice("aab"), T0 + timedelta(hours=rnd.randrange(900))) for i in range(150)], columns=["lid", "k", "t"])
    right = pd.DataFrame([(i, rnd.choice("aac"), T0 + timedelta(hours=rnd.randrange(900))) for i in range(120)], columns=["rid", "k", "rt"])
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "rt", ["rid"], direction, tolerance, tie="rid", bucket_hours=48)
    mine = {r.lid: (r.match.rid if r.match else None) for r in got.collect()}
    for row in left.itertuples():
        c = right[right.k == row.k].copy()
        c["gap"] = (row.t - c.rt).dt.total_seconds() / 3600
        if direction == "backward":
            c = c[c.gap >= 0]
        c["abs"] = c.gap.abs()
        if tolerance is not None:
            c = c[c["abs"] <= tolerance]
        c = c.sort_values(["abs", "rt", "rid"])
        assert mine[row.lid] == (c.iloc[0].rid if len(c) else None)


def test_numbering_and_percentiles_in_slices(spark):
    rnd = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rnd.choice(["hot"] * 5 + ["x", "y"], 3000), "v": np.round(rnd.normal(size=3000), 2), "ts": [T0 + timedelta(minutes=int(m)) for m in rnd.permutation(3000)]})
    df = spark.createDataFrame(pdf)
    n = numbered(df.withColumn("_s", time_slice(F.col("ts"), 6)), ["k"], "_s", ["ts"]).toPandas()
    want = pdf.sort_values("ts").groupby("k").cumcount() + 1
    assert (n.sort_values("ts").seq.to_numpy() == want.sort_index().loc[pdf.sort_values("ts").index].to_numpy()).all()
    p = exact_percentiles(df, "v", {"a": 0.05, "b": 0.5, "c": 0.95}, ["k"], slices=7, also=[F.count(F.lit(1)).alias("n")]).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        assert np.allclose(p.loc[k, ["a", "b", "c"]].to_numpy(dtype=float), np.quantile(part.v, [0.05, 0.5, 0.95])) and p.loc[k, "n"] == len(part)
    c = cumulative_by_value(df, "v", {"n": F.lit(1)}, descending=True, slices=9).toPandas().sort_values("v", ascending=False)
    assert (c.cum_n.to_numpy() == c.n.cumsum().to_numpy()).all()


def test_quality_blocks_equal_one_window(spark):
    rnd = random.Random(5)
    rows = [(i, "d", "rainfall", T0 + timedelta(minutes=rnd.choice([10, 10, 10, 90]) + 10 * i), rnd.choice([1.0] * 9 + [250.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, device_id string, observed_property string, phenomenon_time timestamp, result_value double")
    cut = N.quality(df, block_rows=37).select("id", "quality")
    whole = N.quality(df, block_rows=1000).select("id", "quality")
    assert cut.exceptAll(whole).count() == 0 and cut.count() == 400
    assert {r.quality for r in whole.distinct().collect()} >= {"ok", "range", "spike"}


def test_velocity_and_motion(spark):
    rows = [(i, "d1", "displacement", T0 + timedelta(minutes=10 * i), 100 + 5.0 * i / 6, "ok") for i in range(6)]
    rows += [(10, "d1", "displacement", T0 + timedelta(hours=1, minutes=1), 110.0, "ok"), (11, "d1", "displacement", T0 + timedelta(hours=1, minutes=31), 115.0, "ok")]
    obs = spark.createDataFrame(rows, "id long, device_id string, observed_property string, phenomenon_time timestamp, result_value double, quality string")
    f = N.hourly_features(obs, F.date_trunc("hour", "phenomenon_time")).withColumn("cell_id", F.lit("c"))
    m = N.with_motion(N.merge_devices(f)).orderBy("bucket").collect()
    assert m[0].velocity_mmd == pytest.approx(120.0) and m[0].sample_count == 6 and m[0].acceleration_mmd2 is None
    assert m[1].velocity_mmd == pytest.approx(240.0) and m[1].acceleration_mmd2 == pytest.approx(2880.0)


def test_metrics_known_answers(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.2)], "label int, prob double")
    assert E.average_precision(df).first()[0] == pytest.approx((1 + 1 + 0.75) / 3)
    perfect = spark.createDataFrame([(1, 1.0), (0, 0.0)], "label int, prob double")
    assert E.average_precision(perfect).first()[0] == 1.0 and E.skill_at(perfect, 0.5).first().tss == 1.0
    same = df.select(F.col("prob").alias("v"))
    assert E.ks_distance(same, same).first().ks == 0.0 and E.population_stability(same, same).first().psi == 0.0
    far = same.select((F.col("v") + 5).alias("v"))
    assert E.ks_distance(same, far).first().ks == 1.0 and E.population_stability(same, far).first().psi > 1


def test_backtest_counts_only_the_first_alert(spark):
    h = lambda n: T0 + timedelta(hours=n)
    alerts = spark.createDataFrame([("a", h(0)), ("a", h(190)), ("b", h(10)), ("c", h(5))], "cell_id string, ts timestamp")
    truth = spark.createDataFrame([("a", h(200)), ("b", h(30)), ("d", h(1))], "cell_id string, event_time timestamp")
    r = E.backtest_scores(alerts, truth).first()
    assert (r.hits, r.misses, r.false_alarms, r.mean_lead_h) == (1, 2, 2, 20.0)


def polygon(rnd, cx, cy, n=9):
    ang = np.sort([rnd.uniform(0, 2 * np.pi) for _ in range(n)])
    rad = np.array([rnd.uniform(0.02, 0.12) for _ in range(n)])
    return (cx + rad * np.cos(ang)).tolist(), (cy + rad * np.sin(ang)).tolist()


def inside(px, py, xs, ys):
    c = False
    for i in range(len(xs)):
        j = (i + 1) % len(xs)
        if (ys[i] > py) != (ys[j] > py) and px < xs[i] + (py - ys[i]) / (ys[j] - ys[i]) * (xs[j] - xs[i]):
            c = not c
    return c


def test_points_in_concave_polygons(spark):
    rnd = random.Random(11)
    polys = [(g, *polygon(rnd, 10 + rnd.random(), 40 + rnd.random())) for g in range(12)]
    pts = [(i, 10 + rnd.random(), 40 + rnd.random()) for i in range(400)]
    e = X.ring_edges(spark.createDataFrame(polys, "geom_id int, xs array<double>, ys array<double>"))
    got = {(r.point_id, r.geom_id) for r in X.points_in_polygons(spark.createDataFrame(pts, "point_id int, x double, y double"), e).collect()}
    assert got == {(i, g) for i, x, y in pts for g, xs, ys in polys if inside(x, y, xs, ys)}


def test_overlap_area_of_concave_polygons(spark):
    rnd = random.Random(4)
    polys = [(g, *polygon(rnd, 10 + 0.3 * rnd.random(), 40 + 0.3 * rnd.random())) for g in range(4)]
    cells = [(i, 10 + 0.05 * (i % 7), 40 + 0.05 * (i // 7)) for i in range(49)]
    e = X.ring_edges(spark.createDataFrame(polys, "geom_id int, xs array<double>, ys array<double>"))
    got = Z.overlap_areas(spark.createDataFrame(cells, "cell_id int, lon double, lat double"), e, half=0.025).toPandas()
    n = 60
    for c, lon, lat in cells[::5]:
        for g, xs, ys in polys:
            grid = [(lon - 0.025 + (i + 0.5) * 0.05 / n, lat - 0.025 + (j + 0.5) * 0.05 / n) for i in range(n) for j in range(n)]
            want = sum(inside(x, y, xs, ys) for x, y in grid) / n**2 * 0.05**2
            mine = got[(got.cell_id == c) & (got.geom_id == g)].area.sum()
            assert mine == pytest.approx(want, abs=3e-5)


def test_nearest_feature_in_sparse_and_dense_country(spark):
    rnd = random.Random(2)
    feats = [(10 + 0.001 * rnd.random(), 40 + 0.001 * rnd.random(), "x") for _ in range(300)] + [(10.3, 40.2, "y"), (11.4, 40.9, "z")]
    cells = [(i, 9.5 + 2.5 * rnd.random(), 39.5 + 2 * rnd.random()) for i in range(150)]
    got = {r.cell_id: r for r in X.nearest_feature(spark.createDataFrame(cells, "cell_id int, lon double, lat double"), spark.createDataFrame(feats, "x double, y double, class string"), keep="class").collect()}
    for i, lon, lat in cells:
        def d(f):
            a, b = np.radians([lat, f[1]])
            h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(f[0] - lon) / 2) ** 2
            return 2 * 6371008.8 * np.arcsin(np.sqrt(h))
        best = min(feats, key=d)
        assert got[i].dist_m == pytest.approx(min(d(best), 50_000.0))
        assert got[i]["class"] == (best[2] if d(best) <= 50_000 else None)


def test_zones_are_connected_components(spark):
    rnd = random.Random(9)
    cells = list({(rnd.randrange(30), rnd.randrange(30)) for _ in range(220)})
    rows = [(f"c{i:03d}", "a" if i % 5 else "b", 10 + 0.01 * x, 40 + 0.01 * y) for i, (x, y) in enumerate(cells)]
    got = {r.cell_id: r.zone for r in C.zones(spark.createDataFrame(rows, "cell_id string, aoi_id string, lon double, lat double"), 0.02).collect()}
    parent = {r[0]: r[0] for r in rows}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, (ax, ay) in zip(rows, cells):
        for b, (bx, by) in zip(rows, cells):
            if a[1] == b[1] and (ax - bx) ** 2 + (ay - by) ** 2 <= 4:
                ra, rb = root(a[0]), root(b[0])
                parent[max(ra, rb)] = min(ra, rb)
    assert got == {r[0]: root(r[0]) for r in rows}


def test_terrain_of_a_plane_and_flat(spark):
    rows = [(k, r, c, (10.0 * c if k == "plane" else 5.0)) for k in ("plane", "flat") for r in range(4) for c in range(4)]
    s = {r.cell_id: r for r in Z.terrain_stats(spark.createDataFrame(rows, "cell_id string, row int, col int, z double"), 10.0).collect()}
    assert s["plane"].slope_deg == pytest.approx(45.0) and s["plane"].aspect_deg == pytest.approx(90.0) and s["flat"].slope_deg == 0 and s["flat"].aspect_deg is None


def test_majority_tie_takes_the_smallest_code(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 2.0), ("a", 0.0), ("b", float("nan")), ("b", 7.0)], "cell_id string, code double")
    assert {r.cell_id: (r.majority, r.pixels) for r in Z.majority_class(df, nodata=0.0).collect()} == {"a": ("2", 2), "b": ("7", 1)}


def test_suppression_walks_islands(spark):
    rnd = random.Random(6)
    rows = [(k, T0 + timedelta(minutes=m)) for k in ("a", "b") for m in sorted(rnd.sample(range(20000), 300))]
    got = suppress_batch(spark.createDataFrame(rows, "cell_id string, ts timestamp"), "cell_id", 180, slice_hours=24).toPandas()
    for k in ("a", "b"):
        us = pd.Series([int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for kk, t in rows if kk == k])
        assert sorted(got[got.cell_id == k].us) == us[greedy_dispatch(us, 180 * 60_000_000)].tolist()


def test_merges(spark):
    old = spark.createDataFrame([(1, 1.0, {"a": "x"}), (2, None, {"a": "y"})], "id int, v double, m map<string,string>")
    new = spark.createDataFrame([(2, 5.0, {"b": "z"}), (1, None, None), (3, 9.0, None)], "id int, v double, m map<string,string>")
    got = {r.id: (r.v, r.m) for r in R.merge_coalescing(old, new, ["id"], maps=["m"]).collect()}
    assert got == {1: (1.0, {"a": "x"}), 2: (5.0, {"a": "y", "b": "z"}), 3: (9.0, None)}
    ver = lambda d: R.content_version(d).first().version
    a = spark.range(50).select("id", (F.col("id") % 3).alias("k"))
    assert ver(a) == ver(a.repartition(7).orderBy(F.desc("id"))) != ver(a.union(a.limit(1)))


def test_training_set_and_folds(spark):
    cells = spark.createDataFrame([(i, 10 + 0.1 * i, 40.0) for i in range(60)], "cell_id int, lon double, lat double")
    events = spark.createDataFrame([(1, T0), (1, T0), (2, T0 - timedelta(days=9))], "cell_id int, event_time timestamp_ntz")
    s = L.training_set(events, cells, F.lit("2023-12-31").cast("timestamp_ntz")).toPandas()
    assert (s.label == 1).sum() == 1 and (s.label == 0).sum() == 5 and 1 not in s[s.label == 0].cell_id.tolist()
    f = L.folds(spark.createDataFrame([(f"b{i}",) for i in range(10)], "split_block string"), 5).toPandas()
    assert f.fold.value_counts().tolist() == [2] * 5


def test_collinear_twin_is_dropped_once(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 3), 1.0) for i in range(30)], "a double, b double, c double, d double")
    assert [(r.kept, r.dropped) for r in L.prune_collinear(df, ["a", "b", "c", "d"], 0.95).collect()] == [("a", "b")]
