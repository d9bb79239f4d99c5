"""Polygons cut into pieces of few edges: a tree of tiles per polygon.

A tile with more than ``MOST`` edges is cut into 4 x 4 tiles, again and again.
What is left are rim pieces with at most that many edges and whole pieces without
any, which lie inside or outside as a whole; those outside are dropped. A piece
knows whether its lower right corner is inside. From there to a point of the piece
it is up the right border and then left, and only edges of the piece can cross that way, so a
point test never sees more than one piece's edges however large the polygon is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.operators.relational import few_rows, sized_join
from slopewatch.session import cut_lineage

MOST = 64  # edges of a piece
CUT = 4  # tiles a tile is cut into, each way
DEEPEST = 10  # cuts at most: more edges than MOST are left only where they meet in one point
SLACK = 1e-9  # of a tile's side: edges so close to a tile count as its own
_KEY = ["level", "qx", "qy"]
_EDGE = ["x1", "y1", "x2", "y2"]


def frames(edges: DataFrame, geom_id: str) -> DataFrame:
    """(geom_id, x0, y0, side, minx, ...) of a square around each polygon.

    Its origin is moved by odd shares of the size, so that the borders of tiles do
    not run through vertices.
    """
    box = edges.groupBy(geom_id).agg(
        F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"),
        F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"),
    )
    size = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) + 1e-9
    return box.select(
        geom_id, (F.col("minx") - size * 0.0073194871).alias("x0"), (F.col("miny") - size * 0.0061728395).alias("y0"), (size * 1.0219876543).alias("side"),
        "minx", "miny", "maxx", "maxy",
    )


def tile_side(level: Column) -> Column:
    return F.col("side") / F.pow(F.lit(float(CUT)), level)


def corner(q: Column, origin: str, level: Column) -> Column:
    """Lower coordinate of tile ``q`` at a level."""
    return F.col(origin) + q * tile_side(level)


def _crossing(y: Column) -> Column:
    """Where the edge passes height ``y``; null for a level edge."""
    return F.col("x1") + F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))


def turns(px: Column, py: Column, right: Column, bottom: Column) -> Column:
    """Does the edge cross the way from (right, bottom) up to (right, py) and left to (px, py) an odd number of times?"""
    spans_y = (F.col("y1") > py) != (F.col("y2") > py)
    x = _crossing(py)
    left = spans_y & ((x > px) != (x > right))
    spans_x = (F.col("x1") > right) != (F.col("x2") > right)
    y = F.col("y1") + F.try_divide(right - F.col("x1"), F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    up = spans_x & ((y > bottom) != (y > py))
    no = F.lit(False)
    return F.coalesce(left, no) != F.coalesce(up, no)


def _meets(x: Column, y: Column, half: Column) -> Column:
    """Does the edge meet the closed square around (x, y)? Separating axes."""
    ax, ay, bx, by = F.col("x1") - x, F.col("y1") - y, F.col("x2") - x, F.col("y2") - y
    overlap = (F.least(ax, bx) <= half) & (F.greatest(ax, bx) >= -half) & (F.least(ay, by) <= half) & (F.greatest(ay, by) >= -half)
    nx, ny = by - ay, ax - bx
    return overlap & (F.abs(nx * ax + ny * ay) <= half * (F.abs(nx) + F.abs(ny)))


@dataclass(frozen=True)
class Cut:
    """Polygons in pieces."""

    pieces: DataFrame  #: geom_id, level, qx, qy, x0, y0, side, n (edges; with 0 all of it is inside), corner_in
    rims: DataFrame  #: edges of the pieces: geom_id, level, qx, qy, x1, y1, x2, y2
    boxes: DataFrame  #: geom_id, minx, miny, maxx, maxy
    depth: int  #: greatest level
    hint: str  #: how to join pieces and rims: "broadcast" only if both have few rows


def polygon_pieces(edges: DataFrame, geom_id: str = "geom_id", most: int = MOST, deepest: int = DEEPEST) -> Cut:
    """Cut polygons until no tile above the ``deepest`` level has more than ``most`` edges.

    Each round is
    one aggregation that combines before the shuffle, then the edges of tiles that are
    cut go to the tiles they touch. Rounds end when no tile is left to cut.
    """
    level0 = [F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("qx"), F.lit(0).cast("bigint").alias("qy")]
    boxes = cut_lineage(frames(edges, geom_id))
    place = ["x0", "y0", "side"]
    live = sized_join(edges.select(geom_id, *_EDGE), boxes.select(geom_id, *place), geom_id).select(geom_id, *level0, *place, *_EDGE)
    nodes = boxes.select(geom_id, *level0, *place, F.lit(False).alias("corner_in"))
    done: list[DataFrame] = []
    done_edges: list[DataFrame] = []
    key = [geom_id, *_KEY]
    for level in range(deepest + 1):
        here, small = F.lit(level), tile_side(F.lit(level + 1))
        counted = live.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        known = cut_lineage(nodes.join(counted.hint("merge"), key, "left").withColumn("n", F.coalesce("n", F.lit(0))))
        cut = known.filter(F.col("n") > most)
        if level == deepest or cut.isEmpty():
            done.append(known.select(*key, *place, "n", "corner_in"))
            done_edges.append(live.select(*key, *_EDGE))
            break
        done.append(known.filter(F.col("n") <= most).select(*key, *place, "n", "corner_in"))
        marked = cut_lineage(sized_join(live, cut.select(*key, F.lit(True).alias("cut")), key, "left"))
        done_edges.append(marked.filter("cut is null").select(*key, *_EDGE))
        right, bottom = corner(F.col("qx") + 1, "x0", here), corner(F.col("qy"), "y0", here)
        below = F.lit(level + 1)
        odd = {
            (i, j): F.count_if(turns(corner(F.col("qx") * CUT + i + 1, "x0", below), corner(F.col("qy") * CUT + j, "y0", below), right, bottom)) % 2 == 1
            for i in range(CUT) for j in range(CUT)
        }
        corners = marked.filter("cut").groupBy(*key).agg(*[c.alias(f"t{i}_{j}") for (i, j), c in odd.items()])
        children = F.array(*[F.struct(
            (F.col("qx") * CUT + i).alias("qx"), (F.col("qy") * CUT + j).alias("qy"), (F.col("corner_in") != F.col(f"t{i}_{j}")).alias("corner_in"),
        ) for i, j in odd])
        nodes = cut.join(corners.hint("merge"), key).withColumn("_c", F.explode(children)).select(geom_id, F.lit(level + 1).alias("level"), "_c.qx", "_c.qy", *place, "_c.corner_in")
        span = lambda lo, origin, q: F.sequence(
            F.greatest(F.col(q) * CUT, F.floor((F.least(*lo) - F.col(origin)) / small - 1e-6)), F.least(F.col(q) * CUT + CUT - 1, F.floor((F.greatest(*lo) - F.col(origin)) / small + 1e-6)))
        spread = marked.filter("cut").withColumn("_x", F.explode(span(("x1", "x2"), "x0", "qx"))).withColumn("_y", F.explode(span(("y1", "y2"), "y0", "qy")))
        half = small / 2
        touched = spread.filter(_meets(F.col("x0") + F.col("_x") * small + half, F.col("y0") + F.col("_y") * small + half, half * (1 + SLACK)))
        live = touched.select(geom_id, F.lit(level + 1).alias("level"), F.col("_x").alias("qx"), F.col("_y").alias("qy"), *place, *_EDGE)

    pieces, rims = done[0], done_edges[0]
    for more, rim in zip(done[1:], done_edges[1:], strict=True):
        pieces, rims = pieces.unionByName(more), rims.unionByName(rim)
    small = few_rows(pieces) and few_rows(rims)
    return Cut(
        pieces.filter((F.col("n") > 0) | F.col("corner_in")), rims, boxes.select(geom_id, "minx", "miny", "maxx", "maxy"), len(done) - 1,
        "broadcast" if small else "merge",
    )


def inside_pieces(candidates: DataFrame, cut: Cut, geom_id: str = "geom_id") -> DataFrame:
    """Rows (x, y, geom_id) of ``candidates`` whose point is inside the polygon; points are distinct.

    A candidate asks at every level of its polygon for the tile it lies in; one
    piece answers, or none outside. Whole pieces answer at once, rim pieces by the
    parity over their own edges.
    """
    if cut.depth == 0:  # every polygon is one piece
        found = candidates.join(cut.pieces.hint(cut.hint), geom_id)
    else:
        levels = cut.pieces.groupBy(geom_id).agg(F.max("level").alias("_deep"), *[F.first(c).alias(c) for c in ("x0", "y0", "side")])
        asked = candidates.join(levels.hint(cut.hint), geom_id).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_deep"))))
        tile = lambda v, origin: F.floor((F.col(v) - F.col(origin)) / tile_side(F.col("level")))
        asked = asked.withColumns({"qx": tile("x", "x0"), "qy": tile("y", "y0")}).select(geom_id, *_KEY, "x", "y")
        found = asked.join(cut.pieces.hint(cut.hint), [geom_id, *_KEY])
    whole = found.filter(F.col("n") == 0).select("x", "y", geom_id)
    right, bottom = corner(F.col("qx") + 1, "x0", F.col("level")), corner(F.col("qy"), "y0", F.col("level"))
    met = found.filter(F.col("n") > 0).join(cut.rims.hint(cut.hint), [geom_id, *_KEY])
    odd = (F.count_if(turns(F.col("x"), F.col("y"), right, bottom)) % 2 == 1) != F.first("corner_in")
    rim = met.groupBy("x", "y", geom_id).agg(odd.alias("_in")).filter("_in").select("x", "y", geom_id)
    return whole.unionByName(rim)


def piece_boxes(pieces: DataFrame) -> DataFrame:
    """Pieces with their extent ``px0, py0, px1, py1``."""
    return pieces.withColumns({
        "px0": corner(F.col("qx"), "x0", F.col("level")), "py0": corner(F.col("qy"), "y0", F.col("level")),
        "px1": corner(F.col("qx") + 1, "x0", F.col("level")), "py1": corner(F.col("qy") + 1, "y0", F.col("level")),
    })
