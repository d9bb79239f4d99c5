"""Spatial joins as equi-joins on tile keys.

Spark plans no spatial predicates, so candidates come from an equi-join on
fixed-size tiles and the exact test is ordinary arithmetic afterwards.
Polygons are edge tables (``geom_id, x1, y1, x2, y2``), cut into pieces of few
edges (``pieces.py``), so that even a very large one is many small tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.functions.geo import (
    haversine_m,
    to_3035,
)
from slopewatch.operators.pieces import Cut, inside_pieces, piece_boxes, polygon_pieces
from slopewatch.operators.pyramid import count_in_reach, great_circle, nearest_by_group, square_degrees
from slopewatch.operators.relational import latest_per_key, sized_join


def tile_of(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size))


def tiles_of_box(minx: Column, miny: Column, maxx: Column, maxy: Column, size: float) -> Column:
    """Array of (tx, ty) tiles a box touches."""
    cols = F.sequence(tile_of(minx, size), tile_of(maxx, size))
    rows = F.sequence(tile_of(miny, size), tile_of(maxy, size))
    return F.flatten(
        F.transform(cols, lambda c: F.transform(rows, lambda r: F.struct(c.alias("tx"), r.alias("ty"))))
    )


def ring_edges(polygons: DataFrame, geom_id: str = "geom_id", xs: str = "xs", ys: str = "ys") -> DataFrame:
    """Edge table of rings stored as two coordinate arrays (closed implicitly)."""
    n = F.size(xs)
    edge = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.element_at(xs, i).alias("x1"), F.element_at(ys, i).alias("y1"),
            F.element_at(xs, (i % n) + 1).alias("x2"), F.element_at(ys, (i % n) + 1).alias("y2"),
        ),
    )
    return polygons.select(geom_id, F.explode(edge).alias("e")).select(geom_id, "e.*")


def ring_boxes(edges: DataFrame, geom_id: str = "geom_id") -> DataFrame:
    """Bounding box per geometry."""
    return edges.groupBy(geom_id).agg(
        F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"),
        F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"),
    )


def metric_areas(edges: DataFrame, geom_id: str = "geom_id") -> DataFrame:
    """Area in square metres per geometry on the equal-area grid, ``area_m2``.

    A sum over edges, so a ring of any length combines on the map side. The
    offset keeps the products small.
    """
    (x1, y1), (x2, y2) = to_3035("x1", "y1"), to_3035("x2", "y2")
    near = edges.select(geom_id, *[(c - o).alias(n) for c, o, n in ((x1, 4.3e6, "a"), (y1, 2.2e6, "b"), (x2, 4.3e6, "c"), (y2, 2.2e6, "d"))])
    cross = F.col("a") * F.col("d") - F.col("c") * F.col("b")
    return near.groupBy(geom_id).agg((F.abs(F.sum(cross)) / 2).alias("area_m2"))


def edges_by_slab(edges: DataFrame, slab: float) -> DataFrame:
    """Edges repeated for every latitude slab they touch."""
    lo = tile_of(F.least("y1", "y2"), slab)
    hi = tile_of(F.greatest("y1", "y2"), slab)
    return edges.withColumn("slab", F.explode(F.sequence(lo, hi)))


def box_candidates(points: DataFrame, boxes: DataFrame, tile: float, geom_id: str = "geom_id") -> DataFrame:
    """Pairs (point, geometry) whose bounding box holds the point."""
    keyed = boxes.withColumn("_t", F.explode(tiles_of_box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), tile)))
    keyed = keyed.select(geom_id, "minx", "miny", "maxx", "maxy", F.col("_t.tx").alias("tx"), F.col("_t.ty").alias("ty"))
    at = points.withColumns({"tx": tile_of(F.col("x"), tile), "ty": tile_of(F.col("y"), tile)})
    inside = F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy"))
    return sized_join(at, keyed, ["tx", "ty"]).filter(inside).drop("tx", "ty", "minx", "miny", "maxx", "maxy")


def points_in_polygons(points: DataFrame, edges: DataFrame, point_id: str = "point_id",
                       geom_id: str = "geom_id", tile: float = 0.05, cut: Cut | None = None) -> DataFrame:
    """Pairs (point_id, geom_id) with the point inside, by parity over the edges of one piece of the polygon.

    Points of equal position share the work. ``cut`` are the polygons' pieces, if they are known already.
    """
    cut = cut or polygon_pieces(edges, geom_id)
    cand = box_candidates(points.select("x", "y").distinct(), cut.boxes, tile, geom_id)
    inside = inside_pieces(cand, cut, geom_id)
    return points.select(point_id, "x", "y").join(inside.hint("merge"), ["x", "y"]).select(point_id, geom_id)


def locate_in_grid(points: DataFrame, origins: DataFrame, size_m: float = 1000.0) -> DataFrame:
    """Cell of each point on the metric grid: closed form, one join on the area."""
    x, y = to_3035("lon", "lat")
    placed = points.join(origins, "aoi_id").withColumns({"_x": x, "_y": y})
    row = F.floor((F.col("_y") - F.col("miny")) / size_m).cast("int")
    col = F.floor((F.col("_x") - F.col("minx")) / size_m).cast("int")
    return placed.withColumns(
        {"row_idx": row, "col_idx": col, "cell_id": F.concat_ws("|", "aoi_id", row.cast("string"), col.cast("string"))}
    ).drop("_x", "_y", "minx", "miny", "maxx", "maxy")


def count_within(cells: DataFrame, features: DataFrame, reach: float, half: float = 0.005) -> DataFrame:
    """Features within ``reach`` degrees of each cell square; 0 where there are none."""
    counts = count_in_reach(cells, features, reach, square_degrees(half, reach), 4 * reach)
    return cells.select("cell_id").join(counts, "cell_id", "left").select(
        "cell_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def count_within_m(points: DataFrame, features: DataFrame, radius_m: float, point_id: str = "cell_id") -> DataFrame:
    """(point_id, n): features at most ``radius_m`` from each point (lon, lat); points without any have no row."""
    return count_in_reach(points, features, radius_m, great_circle(radius_m), 4 * radius_m / 110_000.0, point_id)


def nearest_group_within_m(points: DataFrame, features: DataFrame, group: str, radius_m: float, point_id: str) -> DataFrame:
    """(point_id, group, dist): metres from each point to each group of features within ``radius_m``."""
    return nearest_by_group(points, features, group, radius_m, great_circle(radius_m), 4 * radius_m / 110_000.0, point_id)


# --- nearest feature ---------------------------------------------------------
def _bounds(lon: Column, lat: Column, x0: Column, y0: Column, size: float) -> tuple[Column, Column]:
    """Safe lower and upper limits of the metres from a point to anything in a tile."""
    m = 111_195.0
    dx_min = F.greatest(F.lit(0.0), x0 - lon, lon - (x0 + size))
    dy_min = F.greatest(F.lit(0.0), y0 - lat, lat - (y0 + size))
    dx_max = F.greatest(F.abs(lon - x0), F.abs(lon - (x0 + size)))
    dy_max = F.greatest(F.abs(lat - y0), F.abs(lat - (y0 + size)))
    top = F.least(F.lit(90.0), F.greatest(F.abs(lat), F.abs(y0), F.abs(y0 + size)))
    low = F.least(F.abs(lat), F.abs(y0), F.abs(y0 + size))
    c_min = F.cos(F.radians(top))
    c_max = F.when((y0 <= 0) & (y0 + size >= 0), F.lit(1.0)).otherwise(F.cos(F.radians(low)))
    lower = 0.98 * m * F.sqrt(dx_min * dx_min * c_min * c_min + dy_min * dy_min)
    upper = 1.02 * m * F.sqrt(dx_max * dx_max * c_max * c_max + dy_max * dy_max)
    return lower, upper


def nearest_feature(cells: DataFrame, features: DataFrame, cap_m: float = 50_000.0,
                    levels: tuple[float, ...] = (0.64, 0.16, 0.04, 0.01), keep: str | None = None) -> DataFrame:
    """Exact distance from each cell centre to its nearest feature, limited to ``cap_m``.

    Branch and bound over a tile pyramid: at every level a cell keeps only the
    occupied tiles that can still hold its nearest feature, so neither dense nor
    empty country makes all pairs. ``keep`` names a feature column to carry.
    """
    value = F.min(keep) if keep else F.min(F.lit(None).cast("string"))
    spots = features.groupBy("x", "y").agg(value.alias("carried"))
    ratio = [int(round(levels[i] / levels[i + 1])) for i in range(len(levels) - 1)]
    fine = levels[-1]
    keyed = spots.withColumns({"tx": tile_of(F.col("x"), fine), "ty": tile_of(F.col("y"), fine)})
    occupied = [keyed.select("tx", "ty").distinct()]
    for k in reversed(ratio):
        occupied.insert(0, occupied[0].select(F.floor(F.col("tx") / k).alias("tx"), F.floor(F.col("ty") / k).alias("ty")).distinct())

    base = cells.select("cell_id", "lon", "lat")
    reach_y = cap_m / 110_000.0
    reach_x = F.lit(reach_y) / F.greatest(F.lit(0.05), F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("lat")) + reach_y))))
    size = levels[0]
    open_tiles = base.withColumn(
        "_t", F.explode(tiles_of_box(F.col("lon") - reach_x, F.col("lat") - reach_y, F.col("lon") + reach_x, F.col("lat") + reach_y, size))
    ).select("cell_id", "lon", "lat", F.col("_t.tx").alias("tx"), F.col("_t.ty").alias("ty")).join(occupied[0], ["tx", "ty"])
    for depth, size in enumerate(levels):
        if depth:
            k = ratio[depth - 1]
            child = occupied[depth].select(
                F.floor(F.col("tx") / k).alias("px"), F.floor(F.col("ty") / k).alias("py"), F.col("tx").alias("cx"), F.col("ty").alias("cy")
            )
            open_tiles = open_tiles.join(child, (F.col("tx") == F.col("px")) & (F.col("ty") == F.col("py"))).select(
                "cell_id", "lon", "lat", F.col("cx").alias("tx"), F.col("cy").alias("ty")
            )
        lower, upper = _bounds(F.col("lon"), F.col("lat"), F.col("tx") * size, F.col("ty") * size, size)
        bounded = open_tiles.withColumns({"_lo": lower, "_up": upper})
        # tiles per cell are few by construction: occupied tiles inside the cap only
        per_cell = F.min("_up").over(_cell_window())
        open_tiles = bounded.withColumn("_best", per_cell).filter(
            (F.col("_lo") <= F.col("_best")) & (F.col("_lo") <= cap_m)
        ).drop("_lo", "_up", "_best")
    final = open_tiles.join(keyed, ["tx", "ty"]).withColumn(
        "dist_m", haversine_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    ).filter(F.col("dist_m") <= cap_m)
    found = final.groupBy("cell_id").agg(F.min(F.struct("dist_m", "carried")).alias("_m"))
    out = base.select("cell_id").join(found, "cell_id", "left").select(
        "cell_id", F.least(F.coalesce("_m.dist_m", F.lit(cap_m)), F.lit(cap_m)).alias("dist_m"), F.col("_m.carried").alias("carried")
    )
    return out.withColumnRenamed("carried", keep) if keep else out.drop("carried")


def _cell_window():
    from pyspark.sql import Window

    return Window.partitionBy("cell_id")


# --- polygon against cell square ---------------------------------------------
def polygons_touching_cells(cells: DataFrame, edges: DataFrame, half: float = 0.005,
                            geom_id: str = "geom_id", tile: float = 0.05) -> DataFrame:
    """Pairs (cell_id, geom_id) whose square and polygon share a point.

    Pieces of the polygons meet the cells they overlap. A whole piece, and a rim
    piece that lies in the square, settle the pair; only the other rim pieces
    bring their few edges. A square that meets no edge lies inside or outside with its centre.
    """
    cut = polygon_pieces(edges, geom_id)
    keyed = piece_boxes(cut.pieces).withColumn("_t", F.explode(tiles_of_box(F.col("px0"), F.col("py0"), F.col("px1"), F.col("py1"), tile)))
    keyed = keyed.withColumns({"tx": F.col("_t.tx"), "ty": F.col("_t.ty")}).drop("_t")
    c = cells.select("cell_id", "lon", "lat").withColumn(
        "_t", F.explode(tiles_of_box(F.col("lon") - half, F.col("lat") - half, F.col("lon") + half, F.col("lat") + half, tile))
    ).withColumns({"tx": F.col("_t.tx"), "ty": F.col("_t.ty")}).drop("_t")
    left, right, low, high = F.col("lon") - half, F.col("lon") + half, F.col("lat") - half, F.col("lat") + half
    over = (F.col("px0") <= right) & (F.col("px1") >= left) & (F.col("py0") <= high) & (F.col("py1") >= low)
    pairs = c.join(keyed.hint("merge"), ["tx", "ty"]).filter(over)
    # an edge may leave a piece by the slack: a piece counts as held only well within the square
    slack = 1e-6 * F.col("side")
    held = (F.col("px0") - slack >= left) & (F.col("px1") + slack <= right) & (F.col("py0") - slack >= low) & (F.col("py1") + slack <= high)
    sure = (F.col("n") == 0) | held
    key = [geom_id, "level", "qx", "qy"]
    rim = pairs.filter(~sure).select("cell_id", "lon", "lat", *key).distinct()
    met = rim.join(cut.rims.hint(cut.hint), key).filter(segment_meets_box(half)).select("cell_id", geom_id)
    centres = cells.select(F.col("cell_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    inside = points_in_polygons(centres, edges, geom_id=geom_id, tile=tile, cut=cut).withColumnRenamed("point_id", "cell_id")
    return pairs.filter(sure).select("cell_id", geom_id).unionByName(met).unionByName(inside.select("cell_id", geom_id)).distinct()


def segment_meets_box(half: float) -> Column:
    """Does the edge (x1..y2) meet the closed square around (lon, lat)? Separating axes."""
    ax, ay = F.col("x1") - F.col("lon"), F.col("y1") - F.col("lat")
    bx, by = F.col("x2") - F.col("lon"), F.col("y2") - F.col("lat")
    overlap = (F.least(ax, bx) <= half) & (F.greatest(ax, bx) >= -half) & (F.least(ay, by) <= half) & (F.greatest(ay, by) >= -half)
    # the square's projection on the edge normal
    nx, ny = by - ay, ax - bx
    return overlap & (F.abs(nx * ax + ny * ay) <= half * (F.abs(nx) + F.abs(ny)))


def first_containing(pairs: DataFrame, names: DataFrame, geom_id: str = "geom_id") -> DataFrame:
    """One polygon per point: the smallest id among those that contain it."""
    named = sized_join(pairs, names, geom_id)
    return named.groupBy("point_id").agg(F.min_by("name", geom_id).alias("name"))


def most_severe(pairs: DataFrame, hazards: DataFrame, rank: Column, geom_id: str = "geom_id") -> DataFrame:
    """Most severe hazard row per point."""
    ranked = sized_join(pairs, hazards, geom_id).withColumn("_rank", rank)
    return latest_per_key(ranked, ["point_id"], ["_rank", -F.col(geom_id)]).drop("_rank")
