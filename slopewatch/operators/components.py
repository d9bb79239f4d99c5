"""Contiguous zones: connected components of cells within a distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.operators.spatial import tile_of
from slopewatch.session import cut_lineage


def packed(tx: Column, ty: Column) -> Column:
    """Two 32-bit tile numbers in one long: hash aggregation and joins stay on primitives."""
    return F.shiftleft(tx.cast("bigint"), 32).bitwiseOR(ty.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def tile_size(eps: float) -> float:
    """Side of a tile whose diagonal stays below ``eps``."""
    return eps / 1.4142135623730951 * 0.999999


def neighbour_edges(spots: DataFrame, eps: float) -> DataFrame:
    """Links (scope, a, b) between tiles that suffice for connectivity at distance ``eps``.

    ``spots(scope, x, y, tx, ty)`` are distinct positions. A tile is connected
    by itself, so only tile pairs are linked and a dense tile yields no pairs
    among its own points.
    """
    reach = eps * (1 + 1e-9)
    shifts = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    moved = spots.withColumn(
        "_s", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in shifts]))
    ).select(
        "scope", F.col("x").alias("x2"), F.col("y").alias("y2"),
        (F.col("tx") - F.col("_s.dx")).alias("tx"), (F.col("ty") - F.col("_s.dy")).alias("ty"), packed(F.col("tx"), F.col("ty")).alias("b"),
    )
    # a spot can link to the other tile only within eps of that tile's extent
    extent = spots.groupBy("scope", "tx", "ty").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    close = moved.join(extent, ["scope", "tx", "ty"]).filter(
        F.col("x2").between(F.col("x0") - reach, F.col("x1") + reach) & F.col("y2").between(F.col("y0") - reach, F.col("y1") + reach)
    ).drop("x0", "x1", "y0", "y1")
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    near = close.join(spots, ["scope", "tx", "ty"]).filter(dx * dx + dy * dy <= F.lit(reach * reach))
    return near.select("scope", packed(F.col("tx"), F.col("ty")).alias("a"), "b").distinct()


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Component label per node: the smallest node id reachable.

    ``nodes(scope, id)``, ``edges(scope, a, b)`` undirected. Each round takes the
    least label among the neighbours and then jumps to the label's own label, so
    the number of rounds grows with the logarithm of the diameter. Lineage is cut
    every round in the shared folder; the driver sees one flag per round.
    """
    both = cut_lineage(
        edges.select("scope", "a", "b").unionByName(edges.select("scope", F.col("b").alias("a"), F.col("a").alias("b")))
    )
    labels = nodes.select("scope", "id", F.col("id").alias("label"))
    while True:
        offered = both.join(labels.withColumnRenamed("id", "b"), ["scope", "b"]).groupBy("scope", F.col("a").alias("id")).agg(F.min("label").alias("offer"))
        lowered = labels.join(offered, ["scope", "id"], "left").select("scope", "id", "label", F.least("label", "offer").alias("low"))
        # hook: the node that gave the old label is offered the lower one as well
        hooks = lowered.filter(F.col("low") < F.col("label")).groupBy("scope", F.col("label").alias("id")).agg(F.min("low").alias("hook"))
        hooked = lowered.join(hooks, ["scope", "id"], "left").select("scope", "id", "label", F.least("low", "hook").alias("low"))
        jump = hooked.select("scope", F.col("id").alias("low"), F.col("low").alias("far"))
        new = F.least("low", F.coalesce("far", "low"))
        stepped = cut_lineage(
            hooked.join(jump, ["scope", "low"], "left").select("scope", "id", new.alias("label"), (new < F.col("label")).alias("moved"))
        )
        labels = stepped.select("scope", "id", "label")
        if stepped.filter("moved").isEmpty():
            return labels


def zones(cells: DataFrame, eps: float, scope: str = "aoi_id") -> DataFrame:
    """Cells with ``zone``: contiguous groups inside each area, every cell in one.

    The zone id is the smallest cell id of the zone.
    """
    size = tile_size(eps)
    tiled = cut_lineage(cells.withColumns({"tx": tile_of(F.col("lon"), size), "ty": tile_of(F.col("lat"), size)}))
    spots = tiled.select(F.col(scope).alias("scope"), F.col("lon").alias("x"), F.col("lat").alias("y"), "tx", "ty").distinct()
    nodes = tiled.select(F.col(scope).alias("scope"), packed(F.col("tx"), F.col("ty")).alias("id")).distinct()
    labels = connected(nodes, neighbour_edges(spots, eps)).select(F.col("scope").alias(scope), F.col("id").alias("_n"), "label")
    joined = tiled.withColumn("_n", packed(F.col("tx"), F.col("ty"))).join(labels, [scope, "_n"])
    first = joined.groupBy(scope, "label").agg(F.min("cell_id").alias("zone"))
    return joined.join(first, [scope, "label"]).select(*cells.columns, "zone")


def zone_summary(members: DataFrame, half: float = 0.005) -> DataFrame:
    """Size, best cell, members' extent per zone; ``zone_rank`` by (-max, first cell)."""
    best = F.struct((-F.col("score")).alias("_s"), "cell_id", "level")
    out = members.groupBy("aoi_id", "zone").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.max("score").alias("max_score"),
        F.min(best).alias("_best"),
        F.min(F.col("lon") - half).alias("minx"), F.min(F.col("lat") - half).alias("miny"),
        F.max(F.col("lon") + half).alias("maxx"), F.max(F.col("lat") + half).alias("maxy"),
    )
    return out.select(
        "aoi_id", "zone", "n_cells", "max_score",
        F.col("_best.cell_id").alias("dominant_cell"), F.col("_best.level").alias("level"),
        "minx", "miny", "maxx", "maxy",
        ((F.col("minx") + F.col("maxx")) / 2).alias("center_lon"),
        ((F.col("miny") + F.col("maxy")) / 2).alias("center_lat"),
    )
