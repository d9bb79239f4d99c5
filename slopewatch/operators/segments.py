"""Nearest line segment by branch and bound over a tree of tiles.

A tile with more segments than a leaf may hold is cut into 4 x 4 tiles, and each
of its segments goes to those it touches. The closest point of a segment lies in one of
the segment's tiles, so a cell may leave out every tile that lies farther than some
segment is sure to be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.geo import haversine_m, segment_position
from slopewatch.operators.pyramid import M_PER_DEG, great_circle
from slopewatch.operators.relational import lookup_join
from slopewatch.session import cut_lineage

MOST = 16  # segments of a leaf, unless it is the finest tile
CUT = 4
TOP = 0.64  # degrees of a coarse tile
LEVELS = 6
_KEY = ["level", "tx", "ty"]
_LINE = ["x1", "y1", "x2", "y2"]


def side_at(level: Column) -> Column:
    return F.lit(TOP) / F.pow(F.lit(float(CUT)), level)


def _touches(side: Column) -> Column:
    """Does the segment meet the closed tile (tx, ty)? Separating axes, with some slack."""
    half = side / 2 * (1 + 1e-9)
    x, y = (F.col("tx") + 0.5) * side, (F.col("ty") + 0.5) * side
    ax, ay, bx, by = F.col("x1") - x, F.col("y1") - y, F.col("x2") - x, F.col("y2") - y
    nx, ny = by - ay, ax - bx
    return (F.least(ax, bx) <= half) & (F.greatest(ax, bx) >= -half) & (F.least(ay, by) <= half) & (F.greatest(ay, by) >= -half) & (
        F.abs(nx * ax + ny * ay) <= half * (F.abs(nx) + F.abs(ny)))


def _spread(lines: DataFrame, level: int, within: bool) -> DataFrame:
    """Lines with the tiles of ``level`` they touch, inside their tile of the level before if ``within``."""
    side = side_at(F.lit(level))
    lo = lambda a, b: F.floor(F.least(a, b) / side - 1e-6)
    hi = lambda a, b: F.floor(F.greatest(a, b) / side + 1e-6)
    x0, x1, y0, y1 = lo("x1", "x2"), hi("x1", "x2"), lo("y1", "y2"), hi("y1", "y2")
    if within:
        x0, x1 = F.greatest(x0, F.col("tx") * CUT), F.least(x1, F.col("tx") * CUT + CUT - 1)
        y0, y1 = F.greatest(y0, F.col("ty") * CUT), F.least(y1, F.col("ty") * CUT + CUT - 1)
    got = lines.select(*_LINE, F.explode(F.sequence(x0, x1)).alias("_x"), y0.alias("_y0"), y1.alias("_y1")).withColumn("_y", F.explode(F.sequence("_y0", "_y1")))
    return got.select(*_LINE, F.lit(level).alias("level"), F.col("_x").alias("tx"), F.col("_y").alias("ty")).filter(_touches(side))


def segment_tiles(segments: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame, int]:
    """Tiles (level, tx, ty, n, leaf), lines of the leaves (level, tx, ty, x1, y1, x2, y2), and the number of levels.

    Each level is one count per tile that combines before the shuffle; only tiles
    of more than ``most`` lines go on.
    """
    live = _spread(segments.select(*_LINE).distinct(), 0, False)
    tiles, lines = [], []
    for level in range(LEVELS):
        last = level == LEVELS - 1
        counted = live.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).withColumn("leaf", (F.col("n") <= most) | F.lit(last))
        marked = cut_lineage(lookup_join(live, counted.select(*_KEY, "leaf"), _KEY, "inner"))
        tiles.append(marked.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.first("leaf").alias("leaf")))
        lines.append(marked.filter("leaf").select(*_KEY, *_LINE))
        dense = marked.filter(~F.col("leaf"))
        if last or dense.isEmpty():
            break
        live = _spread(dense, level + 1, True)
    all_tiles, all_lines = tiles[0], lines[0]
    for t, l in zip(tiles[1:], lines[1:], strict=True):
        all_tiles, all_lines = all_tiles.unionByName(t), all_lines.unionByName(l)
    return all_tiles, all_lines, len(tiles)


def candidates(cells: DataFrame, segments: DataFrame, box_deg: float = 0.5, cap_m: float = 50_000.0, most: int = MOST) -> DataFrame:
    """(cell_id, lon, lat, x1, y1, x2, y2): the lines that can be a cell's nearest in its search box and within the cap."""
    tiles, lines, levels = segment_tiles(segments, most)
    lon, lat = F.col("lon"), F.col("lat")
    measure = great_circle(cap_m)
    span = lambda v, r: F.sequence(F.floor((v - r) / TOP), F.floor((v + r) / TOP))
    around = cells.select("cell_id", "lon", "lat").withColumn("tx", F.explode(span(lon, measure.reach_x))).withColumn("ty", F.explode(span(lat, measure.reach_y)))
    rows = around.withColumn("level", F.lit(0)).join(tiles, _KEY)
    side = side_at(F.col("level"))
    x, y = F.col("tx") * side, F.col("ty") * side
    lower = measure.bounds(x, y, side)[0]
    # any line of a tile inside the search box counts, and its planar nearest point is no farther than the tile's far corner
    in_box = (x >= lon - box_deg) & (x + side <= lon + box_deg) & (y >= lat - box_deg) & (y + side <= lat + box_deg)
    far = 1.02 * M_PER_DEG * F.hypot(F.greatest(F.abs(lon - x), F.abs(lon - x - side)), F.greatest(F.abs(lat - y), F.abs(lat - y - side)))
    best = F.min("_up").over(Window.partitionBy("cell_id"))
    for level in range(levels):
        bounded = rows.withColumns({"_lo": lower, "_up": F.when(in_box, far).otherwise(F.lit(cap_m))}).withColumn("_best", best)
        rows = bounded.filter((F.col("_lo") <= F.col("_best")) & (F.col("_lo") <= cap_m)).drop("_lo", "_up", "_best")
        if level < levels - 1:
            child = tiles.filter(F.col("level") == level + 1).select(
                F.lit(level).alias("_level"), F.floor(F.col("tx") / CUT).alias("_px"), F.floor(F.col("ty") / CUT).alias("_py"), F.struct("level", "tx", "ty", "n", "leaf").alias("_c"))
            asks = rows.withColumn("_ask", F.when((F.col("level") == level) & ~F.col("leaf"), F.lit(level)).otherwise(F.lit(-1)))
            got = asks.join(child, (F.col("_ask") == F.col("_level")) & (F.col("tx") == F.col("_px")) & (F.col("ty") == F.col("_py")), "left")
            rows = got.select("cell_id", "lon", "lat", *[F.coalesce(f"_c.{c}", c).alias(c) for c in ("level", "tx", "ty", "n", "leaf")])
    hit = (F.least("x1", "x2") <= lon + box_deg) & (F.greatest("x1", "x2") >= lon - box_deg) & (
        F.least("y1", "y2") <= lat + box_deg) & (F.greatest("y1", "y2") >= lat - box_deg)
    return rows.select("cell_id", "lon", "lat", *_KEY).join(lines, _KEY).filter(hit).drop(*_KEY)


def nearest_segment(cells: DataFrame, segments: DataFrame, box_deg: float = 0.5, cap_m: float = 50_000.0, most: int = MOST) -> DataFrame:
    """Distance to the nearest line segment inside a search box, capped.

    The closest point of a segment is planar, its distance great-circle.
    """
    qx, qy = segment_position(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    dist = haversine_m(F.col("lon"), F.col("lat"), qx, qy)
    best = candidates(cells, segments, box_deg, cap_m, most).groupBy("cell_id").agg(F.min(dist).alias("d"))
    return cells.select("cell_id").join(best, "cell_id", "left").select(
        "cell_id", F.least(F.coalesce("d", F.lit(cap_m)), F.lit(cap_m)).alias("dist_m")
    )
