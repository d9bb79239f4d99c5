"""Counting and finding features within reach on a pyramid of tiles.

Every spot lies in one leaf: the coarsest tile that holds few spots, or the finest.
A query starts from the coarse tiles around it. A tile wholly within reach adds its
sum, one wholly beyond is dropped, and only what the rim of the reach crosses is
opened further, down to leaves whose few spots are compared one by one. So a
crowded place costs its rim, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.geo import haversine_m
from slopewatch.session import cut_lineage

MOST = 32  # spots of a leaf, unless it is the finest tile
CUT = 4  # tiles a tile is cut into, each way
LEVELS = 6
M_PER_DEG = 111_195.0

#: (lower, upper) limits of the distance from a query to anything in a tile of given origin and side.
Bounds = Callable[[Column, Column, Column], tuple[Column, Column]]


@dataclass(frozen=True)
class Measure:
    """A distance from a query at (lon, lat): limits for a tile and the value for a spot at (x, y)."""

    bounds: Bounds
    exact: Column
    reach_x: Column
    reach_y: Column


def square_degrees(half: float, reach: float) -> Measure:
    """Planar distance from the square of half-width ``half`` around the query, in degrees."""
    lon, lat = F.col("lon"), F.col("lat")
    gap = lambda v, lo, hi: F.greatest(F.lit(0.0), lo - v - half, v - half - hi)
    far = lambda v, lo, hi: F.greatest(F.lit(0.0), F.abs(lo - v) - half, F.abs(hi - v) - half)

    def bounds(x: Column, y: Column, side: Column) -> tuple[Column, Column]:
        lower = F.hypot(gap(lon, x, x + side), gap(lat, y, y + side))
        upper = F.hypot(far(lon, x, x + side), far(lat, y, y + side))
        return lower * (1 - 1e-9), upper * (1 + 1e-9)

    dx, dy = F.greatest(F.lit(0.0), F.abs(F.col("x") - lon) - half), F.greatest(F.lit(0.0), F.abs(F.col("y") - lat) - half)
    return Measure(bounds, F.sqrt(dx * dx + dy * dy), F.lit(reach + half), F.lit(reach + half))


def great_circle(reach_m: float) -> Measure:
    """Great-circle metres; limits of tiles leave two hundredths of room."""
    lon, lat = F.col("lon"), F.col("lat")

    def bounds(x: Column, y: Column, side: Column) -> tuple[Column, Column]:
        near_x, near_y = F.greatest(F.lit(0.0), x - lon, lon - x - side), F.greatest(F.lit(0.0), y - lat, lat - y - side)
        far_x, far_y = F.greatest(F.abs(lon - x), F.abs(lon - x - side)), F.greatest(F.abs(lat - y), F.abs(lat - y - side))
        steep = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(lat), F.abs(y), F.abs(y + side)))))
        flat = F.when((y <= 0) & (y + side >= 0), F.lit(1.0)).otherwise(F.cos(F.radians(F.least(F.abs(lat), F.abs(y), F.abs(y + side)))))
        return 0.98 * M_PER_DEG * F.hypot(near_x * steep, near_y), 1.02 * M_PER_DEG * F.hypot(far_x * flat, far_y)

    reach = reach_m / 110_000.0
    wide = F.lit(reach) / F.greatest(F.lit(0.05), F.cos(F.radians(F.least(F.lit(89.0), F.abs(lat) + reach))))
    return Measure(bounds, haversine_m(lon, lat, F.col("x"), F.col("y")), wide, F.lit(reach))


class Pyramid:
    """Spots (x, y) with weights on tiles of ``top`` degrees and ``LEVELS`` - 1 cuts; with ``group``, one pyramid per group."""

    def __init__(self, features: DataFrame, top: float, group: Sequence[str] = (), weight: Column | None = None, most: int = MOST) -> None:
        self.top, self.group = top, list(group)
        spots = features.groupBy(*self.group, "x", "y").agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))
        fine = [F.floor(F.col(c) / self.side(F.lit(LEVELS - 1))).alias(t) for c, t in (("x", "fx"), ("y", "fy"))]
        spots = spots.withColumns({"fx": fine[0], "fy": fine[1]})
        own = [*self.group, "fx", "fy"]
        counted = spots.groupBy(*own).agg(F.count(F.lit(1)).alias("spots"), F.sum("n").alias("n"))
        level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
        every = counted.withColumn("level", level)
        shrink = F.pow(F.lit(float(CUT)), F.lit(LEVELS - 1) - F.col("level"))
        every = every.withColumns({"tx": F.floor(F.col("fx") / shrink), "ty": F.floor(F.col("fy") / shrink)})
        tiles = every.groupBy(*self.group, "level", "tx", "ty").agg(F.sum("spots").alias("spots"), F.sum("n").alias("n"))
        last = F.col("level") == LEVELS - 1
        self.tiles = cut_lineage(tiles.withColumn("leaf", (F.col("spots") <= most) | last))
        #: levels that are needed: one more than the finest tile that is cut
        self.levels = 2 + self.tiles.agg(F.coalesce(F.max(F.when(~F.col("leaf"), F.col("level"))), F.lit(-1))).first()[0]
        leaf = every.select(*own, "level", "tx", "ty").join(self.tiles.filter("leaf").select(*self.group, "level", "tx", "ty"), [*self.group, "level", "tx", "ty"])
        leaf = leaf.groupBy(*own).agg(F.min(F.struct("level", "tx", "ty")).alias("t"))
        self.spots = spots.join(leaf, own).select(*self.group, "t.level", "t.tx", "t.ty", "x", "y", "n")

    def side(self, level: Column) -> Column:
        return F.lit(self.top) / F.pow(F.lit(float(CUT)), level)

    def start(self, queries: DataFrame, measure: Measure) -> DataFrame:
        """Queries (id, lon, lat) with the coarse tiles they may reach and what these hold."""
        span = lambda v, r: F.sequence(F.floor((F.col(v) - r) / self.top), F.floor((F.col(v) + r) / self.top))
        around = queries.withColumn("tx", F.explode(span("lon", measure.reach_x))).withColumn("ty", F.explode(span("lat", measure.reach_y)))
        return around.join(self.tiles.filter("level = 0").withColumn("level", F.lit(0)), ["tx", "ty"])

    def open(self, rows: DataFrame, level: int, keep: Sequence[str], opened: Column) -> DataFrame:
        """Rows with every opened tile replaced by its occupied children; the others stay as they are."""
        child = self.tiles.filter(F.col("level") == level + 1).select(
            *[F.col(g).alias(f"_{g}") for g in self.group], F.lit(level).alias("_level"), F.floor(F.col("tx") / CUT).alias("_px"), F.floor(F.col("ty") / CUT).alias("_py"),
            F.struct(F.lit(level + 1).alias("level"), "tx", "ty", "n", "leaf").alias("_c"),
        )
        asks = rows.withColumn("_ask", F.when(opened, F.lit(level)).otherwise(F.lit(-1)))
        on = (F.col("_ask") == F.col("_level")) & (F.col("tx") == F.col("_px")) & (F.col("ty") == F.col("_py"))
        for g in self.group:
            on = on & (F.col(g) == F.col(f"_{g}"))
        got = asks.join(child, on, "left")
        return got.select(*keep, *self.group, *[F.coalesce(f"_c.{c}", c).alias(c) for c in ("level", "tx", "ty", "n", "leaf")])


def count_in_reach(queries: DataFrame, features: DataFrame, reach: float, measure: Measure, top: float, query_id: str = "cell_id",
                   weight: Column | None = None, most: int = MOST) -> DataFrame:
    """(query_id, n): weight of the features at most ``reach`` from each query; queries without any have no row."""
    p = Pyramid(features, top, weight=weight, most=most)
    keep = [query_id, "lon", "lat"]
    rows = p.start(queries.select(*keep), measure).select(*keep, "level", "tx", "ty", "n", "leaf")
    lower, upper = measure.bounds(F.col("tx") * p.side(F.col("level")), F.col("ty") * p.side(F.col("level")), p.side(F.col("level")))
    within = upper <= reach
    for level in range(p.levels):
        rows = rows.filter(lower <= reach)
        if level < p.levels - 1:
            rows = p.open(rows, level, keep, (F.col("level") == level) & ~F.col("leaf") & ~within)
    whole = rows.filter(within).select(query_id, "n")
    rim = rows.filter(~within).select(*keep, "level", "tx", "ty").join(p.spots, ["level", "tx", "ty"]).filter(measure.exact <= reach).select(query_id, "n")
    return whole.unionByName(rim).groupBy(query_id).agg(F.sum("n").alias("n"))


def nearest_by_group(queries: DataFrame, features: DataFrame, group: str, reach: float, measure: Measure, top: float, query_id: str, most: int = MOST) -> DataFrame:
    """(query_id, group, dist): least distance from each query to each group of features within ``reach``.

    Branch and bound: of a group's tiles only those are opened that may hold
    something nearer than the tile with the least upper limit.
    """
    p = Pyramid(features, top, [group], most=most)
    keep = [query_id, "lon", "lat"]
    rows = p.start(queries.select(*keep), measure).select(*keep, group, "level", "tx", "ty", "n", "leaf")
    lower, upper = measure.bounds(F.col("tx") * p.side(F.col("level")), F.col("ty") * p.side(F.col("level")), p.side(F.col("level")))
    best = F.min("_up").over(Window.partitionBy(query_id, group))
    for level in range(p.levels):
        rows = rows.withColumns({"_lo": lower, "_up": upper}).filter(F.col("_lo") <= reach).withColumn("_best", best).filter(F.col("_lo") <= F.col("_best"))
        rows = rows.drop("_lo", "_up", "_best")
        if level < p.levels - 1:
            rows = p.open(rows, level, keep, (F.col("level") == level) & ~F.col("leaf"))
    found = rows.select(*keep, group, "level", "tx", "ty").join(p.spots, [group, "level", "tx", "ty"]).withColumn("dist", measure.exact)
    return found.filter(F.col("dist") <= reach).groupBy(query_id, group).agg(F.min("dist").alias("dist"))
