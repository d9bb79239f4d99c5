"""Sides that a generator multiplied out: Spark takes them for as small as their compressed file, they must not be broadcast."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from slopewatch.operators import spatial as X
from slopewatch.operators import zonal as Z
from slopewatch.operators.pieces import polygon_pieces
from slopewatch.operators.relational import BROADCAST_ROWS, few_rows, sized_join

MANY = BROADCAST_ROWS + 1


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ids(spark, tmp_path_factory):
    """More keys than are broadcast, in a file far below Spark's limit."""
    path = str(tmp_path_factory.mktemp("ids") / "ids.parquet")
    spark.range(MANY).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def squares(ids):
    x, y = F.col("id") % 400 * 0.01, F.floor(F.col("id") / 400) * 0.01
    return X.ring_edges(ids.select(F.col("id").alias("geom_id"), F.array(x, x + 0.005, x + 0.005, x).alias("xs"), F.array(y, y, y + 0.005, y + 0.005).alias("ys")))


def test_rows_are_counted(spark):
    assert few_rows(spark.range(10), 10) and not few_rows(spark.range(11), 10)
    left, table = spark.range(50), spark.range(10, 20).withColumn("v", F.col("id") * 2)
    assert "BroadcastHashJoin" in plan(sized_join(left, table, "id"))
    assert sorted(tuple(r) for r in sized_join(left, table, "id").collect()) == [(i, 2 * i) for i in range(10, 20)]
    assert sized_join(left, table, "id", "left").count() == 50
    assert "SortMergeJoin" in plan(sized_join(left, spark.range(MANY), "id"))


def test_pixels_are_not_broadcast(ids):
    pixels = ids.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        F.col("id").alias("cell_id"), F.floor(F.col("n") / 2).cast("int").alias("row"), (F.col("n") % 2).cast("int").alias("col"), (F.col("n") % 2 * 100.0).alias("z"))
    assert "Broadcast" not in plan(t := Z.terrain(pixels, 100.0))
    row = t.agg(F.count("*"), F.min("slope"), F.max("slope"), F.max(F.abs("aspect"))).first()
    assert row[0] == 4 * MANY and row[1] == pytest.approx(45.0) and row[2] == pytest.approx(45.0)
    few = Z.terrain(pixels.filter("cell_id < 5"), 100.0)
    assert "BroadcastHashJoin" in plan(few) and few.count() == 20


def test_polygons_are_not_broadcast(ids, squares):
    points = ids.select(F.col("id").alias("point_id"), (F.col("id") % 400 * 0.01 + 0.0025).alias("x"), (F.floor(F.col("id") / 400) * 0.01 + 0.0025).alias("y"))
    cut = polygon_pieces(squares)
    assert cut.hint == "merge" and polygon_pieces(squares.filter("geom_id < 5")).hint == "broadcast"
    hits = X.points_in_polygons(points, squares, cut=cut)
    assert "Broadcast" not in plan(hits)
    assert hits.agg(F.count("*"), F.count_if(F.col("point_id") == F.col("geom_id"))).first() == (MANY, MANY)


def test_edges_are_not_broadcast(ids, squares):
    cells = ids.select(F.col("id").alias("cell_id"), (F.col("id") % 400 * 0.01 + 0.005).alias("lon"), (F.floor(F.col("id") / 400) * 0.01 + 0.005).alias("lat"))
    areas = Z.overlap_areas(cells, squares)
    assert "Broadcast" not in plan(areas)
    own = areas.filter(F.col("cell_id") == F.col("geom_id")).agg(F.count("*"), F.min("area"), F.max("area")).first()
    assert own[0] == MANY and own[1] == pytest.approx(2.5e-5) and own[2] == pytest.approx(2.5e-5)


def test_filters_do_not_parse_again(spark):
    from slopewatch.sources import features as SF

    text = '{"type": "Feature", "id": "%s", "properties": {"firedate": "%s"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, %d], [0, 0]]]}}'
    rows = spark.createDataFrame([(text % (k, f"2020-0{k}-01", k),) for k in range(1, 6)], "feature string")
    near = SF.perimeters_in(SF.with_bbox(SF.burnt_areas(rows)), (0.0, 2.5, 1.0, 9.0), "2020-01-01", "2020-04-30").select("id")
    assert sorted(r["id"] for r in near.collect()) == ["3", "4"]
    lines = near._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [x for x in lines if x.strip(" :+-").startswith("Filter")]
    assert filters and not any("json" in x for x in filters)


def test_tasks_are_bounded(spark):
    from slopewatch.session import TASK_BYTES, bounded_tasks

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64m")
    try:
        bounded_tasks(spark)
        assert spark.conf.get(key) == str(TASK_BYTES[key])
        spark.conf.set(key, "1m")
        bounded_tasks(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
