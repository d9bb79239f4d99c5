"""Zonal statistics of pixels, scatterers and overlaid polygons per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.operators.relational import sized_join
from slopewatch.operators.running import exact_percentiles
from slopewatch.operators.spatial import tiles_of_box
from slopewatch.session import cut_lineage


def majority_class(pixels: DataFrame, cell: str = "cell_id", code: str = "code", nodata: float | None = None) -> DataFrame:
    """Most frequent class per cell, smallest code on a tie; nodata and NaN excluded."""
    ok = F.col(code).isNotNull() & ~F.isnan(F.col(code).cast("double"))
    if nodata is not None:
        ok = ok & (F.col(code) != nodata)
    counts = pixels.filter(ok).groupBy(cell, code).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(cell).agg(
        F.max_by(code, F.struct("n", -F.col(code))).alias("majority"), F.sum("n").alias("pixels")
    ).select(cell, F.col("majority").cast("int").cast("string").alias("majority"), "pixels")


def _gradient(value: Column, along: Column, first: Column, last: Column, w: Window) -> Column:
    """Central difference per pixel, one-sided at the edges; null next to a missing pixel."""
    after = F.when(F.lead(along).over(w) == along + 1, F.lead(value).over(w))
    before = F.when(F.lag(along).over(w) == along - 1, F.lag(value).over(w))
    return (
        F.when(along == first, after - value).when(along == last, value - before).otherwise((after - before) / 2.0)
    )


def terrain(pixels: DataFrame, cellsize: float, raster: str = "cell_id") -> DataFrame:
    """Slope, aspect (-1 on flats) and curvature per pixel.

    ``pixels(raster, row, col, z)`` with row 0 in the north. Windows run along
    one pixel row or column of one raster, so their size is the raster's side.
    """
    if cellsize <= 0:
        raise ValueError(f"cell size must be positive: {cellsize}")
    bounds = cut_lineage(pixels.groupBy(raster).agg(
        F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")
    ))
    across = Window.partitionBy(raster, "row").orderBy("col")
    down = Window.partitionBy(raster, "col").orderBy("row")
    p = sized_join(pixels, bounds, raster)
    along_x = lambda v: _gradient(F.col(v), F.col("col"), F.col("c0"), F.col("c1"), across) / cellsize
    along_y = lambda v: -_gradient(F.col(v), F.col("row"), F.col("r0"), F.col("r1"), down) / cellsize
    p = p.withColumn("dx", along_x("z")).withColumn("dy", along_y("z"))
    p = p.withColumn("dxx", along_x("dx")).withColumn("dyy", along_y("dy"))
    flat = (F.abs("dx") < 1e-9) & (F.abs("dy") < 1e-9)
    bearing = F.degrees(F.atan2(F.col("dx"), F.col("dy"))) + 360.0
    return p.withColumns(
        {
            "slope": F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))),
            "aspect": F.when(flat, F.lit(-1.0)).otherwise(bearing - 360.0 * F.floor(bearing / 360.0)),
            "curvature": F.col("dxx") + F.col("dyy"),
        }
    ).drop("dx", "dy", "dxx", "dyy", "r0", "r1", "c0", "c1")


def terrain_stats(pixels: DataFrame, cellsize: float, cell: str = "cell_id") -> DataFrame:
    """Mean elevation, slope and curvature, median aspect off the flats, pixel count."""
    t = terrain(pixels, cellsize, cell)
    means = t.groupBy(cell).agg(
        F.avg("z").alias("elevation_m"), F.avg("slope").alias("slope_deg"), F.avg("curvature").alias("curvature"),
        F.count("z").alias("pixel_count"),
    )
    aspects = exact_percentiles(t.filter(F.col("aspect") >= 0), "aspect", {"aspect_deg": 0.5}, [cell], slices=4)
    return means.join(aspects, cell, "left")


def scatterer_stats(cells: DataFrame, located: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Median motion, count and period per cell; cells without points stay with count 0."""
    base = located.groupBy(cell).agg(
        F.count(F.lit(1)).alias("scatterer_count"), F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end")
    )
    velocity = exact_percentiles(located, "velocity_mmy", {"velocity_mmy": 0.5}, [cell], slices=4)
    accel = exact_percentiles(located, "accel_mmy2", {"accel_mmy2": 0.5}, [cell], slices=4)
    out = cells.select(cell).join(base, cell, "left").join(velocity, cell, "left").join(accel, cell, "left")
    return out.withColumn("scatterer_count", F.coalesce("scatterer_count", F.lit(0)).cast("bigint"))


def overlap_areas(cells: DataFrame, edges: DataFrame, half: float = 0.005, geom_id: str = "geom_id",
                  tile: float = 0.05) -> DataFrame:
    """Area shared by each cell square and polygon, in squared coordinate units.

    Green's theorem edge by edge: an edge adds the signed area under it inside
    the square, so the overlap of any simple polygon is a plain sum that
    combines on the map side. Edges are keyed by (polygon, longitude slab).
    """
    lo_x, hi_x = F.least("x1", "x2"), F.greatest("x1", "x2")
    boxes = edges.groupBy(geom_id).agg(
        F.min(lo_x).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"),
        F.max(hi_x).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"),
    )
    b = boxes.withColumn("_t", F.explode(tiles_of_box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), tile)))
    c = cells.select("cell_id", "lon", "lat").withColumn(
        "_t", F.explode(tiles_of_box(F.col("lon") - half, F.col("lat") - half, F.col("lon") + half, F.col("lat") + half, tile))
    )
    near = (F.col("minx") <= F.col("lon") + half) & (F.col("maxx") >= F.col("lon") - half) & (
        F.col("miny") <= F.col("lat") + half) & (F.col("maxy") >= F.col("lat") - half)
    cand = sized_join(c, b, "_t").filter(near).select("cell_id", "lon", "lat", geom_id).distinct()
    slab = tile
    cand = cand.withColumn("slab", F.explode(F.sequence(F.floor((F.col("lon") - half) / slab), F.floor((F.col("lon") + half) / slab))))
    e = edges.filter(F.col("x1") != F.col("x2")).withColumn("slab", F.explode(F.sequence(F.floor(lo_x / slab), F.floor(hi_x / slab))))
    # each slab contributes its own x-range, so edges and squares may span several
    a = F.greatest(lo_x, F.col("lon") - half, F.col("slab") * slab)
    z = F.least(hi_x, F.col("lon") + half, (F.col("slab") + 1) * slab)
    y_at = lambda x: F.col("y1") + (x - F.col("x1")) / (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) - (F.col("lat") - half)
    ya, yz, h = y_at(a), y_at(z), 2 * half
    primitive = lambda y: F.when(y <= 0, F.lit(0.0)).when(y <= h, y * y / 2).otherwise(h * y - h * h / 2)
    clamp = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(h), y))
    mean = F.when(F.abs(yz - ya) > 1e-12, (primitive(yz) - primitive(ya)) / (yz - ya)).otherwise(clamp((ya + yz) / 2))
    part = F.when(z > a, mean * (z - a) * F.signum(F.col("x2") - F.col("x1"))).otherwise(0.0)
    area = sized_join(cand, e, [geom_id, "slab"]).groupBy("cell_id", geom_id).agg(F.abs(F.sum(part)).alias("area"))
    return area.filter(F.col("area") > 1e-14)


def dominant_label(areas: DataFrame, labels: DataFrame, geom_id: str = "geom_id", digits: int = 12) -> DataFrame:
    """Label with the greatest overlap per cell, ties by label."""
    j = sized_join(areas, labels, geom_id).withColumn("_a", F.round("area", digits))
    return j.groupBy("cell_id").agg(F.min(F.struct((-F.col("_a")).alias("a"), "label")).alias("m")).select(
        "cell_id", F.col("m.label").alias("label")
    )
