"""Readers for inventories, hazard layers, networks, seismic, fire and other feature files.

Every reader takes landed text or Parquet rows and returns typed rows; field
aliases are a ``coalesce`` over JSON paths, so a payload is parsed once and
columns that nobody selects are pruned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopewatch.functions.geo import from_3035
from slopewatch.params import PARAMS

# --- fixed values -----------------------------------------------------------
HAZARD_CLASSES = ("AA", "P1", "P2", "P3", "P4")
HAZARD_TOKEN = r"(?i)\b(AA|P[1-4])\b"
EVENT_DATE_FORMATS = ("dd/MM/yyyy HH:mm", "dd/MM/yyyy")
INVENTORY_FAMILIES = ("frane_poly", "frane_line", "frane_piff", "aree_poly", "dgpv_poly")
GEOMETRY_SUFFIXES = ("piff_line", "piff_poly", "aree_poly", "dgpv_poly")
DOCUMENT_KINDS = {
    ".paper.md": "paper",
    ".paper.txt": "paper",
    ".pai.md": "pai_plan",
    ".ispra.md": "ispra_report",
    ".iffi.md": "iffi_event",
    ".briefing.md": "briefing",
}
RADAR_NODATA = -9999.0
# --- end of fixed values ----------------------------------------------------


def prop(feature: Column, *aliases: str) -> Column:
    """First non-empty of several property names of a GeoJSON feature (text)."""
    found = [F.nullif(F.get_json_object(feature, f"$.properties.{a}"), F.lit("")) for a in aliases]
    return F.coalesce(*found)


def feature_id(feature: Column, *aliases: str) -> Column:
    return F.coalesce(*([prop(feature, *aliases)] if aliases else []), F.nullif(F.get_json_object(feature, "$.id"), F.lit("")))


def short_date(text: Column) -> Column:
    """Date from the first ten characters; null when they are none."""
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def utc_timestamp(text: Column) -> Column:
    """ISO time; a trailing Z or offset is honoured, a naive time is UTC."""
    return F.try_to_timestamp(text)


def collection_features(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One text row per feature of GeoJSON collections.

    A collection is one multi-line document, so the file is the unit of
    parallelism; newline-delimited features are split by Spark instead.
    """
    raw = spark.read.text(path, wholetext=True)
    parts = F.from_json(F.get_json_object("value", "$.features"), "array<variant>")
    return raw.select(F.explode(parts).alias("v")).select(F.to_json("v").alias("feature"))


def feature_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Newline-delimited features, splittable."""
    return spark.read.text(path).withColumnRenamed("value", "feature").filter(F.length(F.trim("feature")) > 0)


def region_seed(features: DataFrame) -> DataFrame:
    """Area rows: id, name and kind are lifted, every other property stays as metadata."""
    props = F.from_json(F.get_json_object("feature", "$.properties"), "map<string,string>")
    rest = F.map_filter(props, lambda k, v: ~k.isin("id", "name", "kind"))
    f = F.col("feature")
    return features.select(
        prop(f, "id").alias("aoi_id"), prop(f, "name").alias("name"), F.coalesce(prop(f, "kind"), F.lit("region")).alias("kind"),
        rest.alias("metadata"), F.get_json_object(f, "$.geometry").alias("geometry"),
    )


def event_catalogue(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) from the delimited catalogue; rows without id, position or date are rejects."""
    from slopewatch.schemas import validate

    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    number = lambda c: text(c).try_cast("double")
    when = F.coalesce(*[F.try_to_timestamp(text("utc_date"), F.lit(f)) for f in EVENT_DATE_FORMATS])
    keep = [c for c in ("temporal_accuracy", "geographic_accuracy", "landslide_type", "region", "province", "municipality") if c in raw.columns]
    rows = raw.select(
        text("id").alias("id"), number("lon").alias("lon"), number("lat").alias("lat"), when.alias("event_time"),
        F.coalesce(text("information_source"), F.lit("unknown")).alias("source") if "information_source" in raw.columns else F.lit("unknown").alias("source"),
        *[text(c).alias(c) for c in keep],
    )
    needed = ("id", "lon", "lat", "event_time")
    return validate(rows, {c: F.col(c).isNotNull() for c in needed})


def read_event_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Semicolon-separated file with a header; a byte-order mark is dropped."""
    raw = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    clean = [F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in raw.columns]
    return event_catalogue(raw.select(*clean))


def seismic(features: DataFrame) -> DataFrame:
    """Earthquakes; rows without position, id, time or magnitude are dropped."""
    f = F.col("feature")
    at = lambda i: F.get_json_object(f, f"$.geometry.coordinates[{i}]").try_cast("double")
    out = features.select(
        F.coalesce(F.nullif(F.get_json_object(f, "$.id"), F.lit("")), prop(f, "eventID", "eventId")).alias("id"),
        utc_timestamp(prop(f, "time", "origintime", "origin_time")).alias("origin_time"),
        prop(f, "mag").try_cast("double").alias("magnitude"),
        prop(f, "magType", "magnitude_type").alias("magnitude_type"),
        at(0).alias("lon"), at(1).alias("lat"), at(2).alias("depth_km"),
        prop(f, "place", "region", "eventLocationName").alias("region"),
    )
    return out.dropna(subset=["id", "lon", "lat", "origin_time", "magnitude"])


def polygon_rings(geometry: Column) -> Column:
    """Rings of a Polygon or MultiPolygon as array of coordinate pairs; null for other types."""
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")
    one = F.from_json(coords, "array<array<array<double>>>")
    many = F.flatten(F.from_json(coords, "array<array<array<array<double>>>>"))
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)


def burnt_areas(features: DataFrame) -> DataFrame:
    """Fire perimeters; non-polygons and rows without an id are dropped, bad dates become null."""
    f = F.col("feature")
    row = F.struct(
        feature_id(f, "id", "OBJECTID").alias("id"),
        short_date(prop(f, "firedate", "FIREDATE", "fire_date")).alias("fire_date"),
        prop(f, "area_ha", "AREA_HA", "AREA").try_cast("double").alias("area_ha"),
        prop(f, "country", "COUNTRY").alias("country"), prop(f, "province", "PROVINCE").alias("province"),
        polygon_rings(F.get_json_object(f, "$.geometry")).alias("rings"),
    )
    # exploded: a filter on the columns does not move below and parse the text again for each of them
    out = features.select(F.explode(F.array(row)).alias("_f")).select("_f.*")
    return out.filter(F.col("id").isNotNull() & F.col("rings").isNotNull())


def with_bbox(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Extent columns of the ring coordinates."""
    flat = F.flatten(rings)
    xs, ys = F.transform(flat, lambda p: p[0]), F.transform(flat, lambda p: p[1])
    return df.withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)})


def perimeters_in(df: DataFrame, bbox: tuple[float, float, float, float] | None = None, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Perimeters whose extent meets the box and whose date lies in the inclusive range."""
    if bbox is not None:
        x0, y0, x1, y1 = bbox
        df = df.filter((F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0))
    if start is not None:
        df = df.filter(F.col("fire_date") >= F.lit(start).cast("date"))
    if stop is not None:
        df = df.filter(F.col("fire_date") <= F.lit(stop).cast("date"))
    return df


def inventory(features: DataFrame) -> DataFrame:
    """Landslide inventory rows with their field aliases resolved."""
    f = F.col("feature")
    out = features.select(
        feature_id(f, "iffi_id", "id_frana", "idfrana").alias("id"),
        prop(f, "movement", "movimento", "mov_principale").alias("movement_type"),
        prop(f, "state", "stato").alias("state"),
        prop(f, "velocity_class", "classe_velocita").alias("velocity_class"),
        short_date(prop(f, "data_evento", "occurrence_date")).alias("occurrence_date"),
        F.get_json_object(f, "$.geometry").alias("geometry"),
    )
    return out.filter(F.col("id").isNotNull() & F.col("geometry").isNotNull())


def hazard_class(text: Column) -> Column:
    """Canonical class, ``UNKNOWN`` for anything off the ladder."""
    clean = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(clean.isin(*HAZARD_CLASSES), clean).otherwise("UNKNOWN")


def hazard_polygons(features: DataFrame) -> DataFrame:
    f = F.col("feature")
    out = features.select(
        feature_id(f, "pai_id", "id_pai", "idpai").alias("id"),
        hazard_class(prop(f, "hazard_class", "classe_pai", "pericolosita", "classe")).alias("hazard_class"),
        prop(f, "authority", "autorita", "autorita_bacino").alias("authority"),
        F.get_json_object(f, "$.geometry").alias("geometry"),
    )
    return out.filter(F.col("id").isNotNull() & F.col("geometry").isNotNull())


def inventory_union(layers: dict[str, DataFrame], region: str, id_column: str = "fid", geometry: str = "wkb") -> DataFrame:
    """Layers of one region in one table; without an id the geometry bytes' hash stands in."""
    parts = []
    for family, df in layers.items():
        rid = F.col(id_column).cast("string") if id_column in df.columns else F.md5(F.col(geometry))
        move = F.col("nome_tipo") if "nome_tipo" in df.columns else F.lit(None).cast("string")
        table = f"{family}_{region}_opendata"
        parts.append(
            df.filter(F.col(geometry).isNotNull()).select(
                F.concat(F.lit(f"{table}:"), rid).alias("id"), move.alias("movement_type"), F.lit(family).alias("family"), F.lit(region).alias("region"), geometry
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hazard_token(label: Column) -> Column:
    """Class token inside a free-text label; null when there is none."""
    return F.upper(F.nullif(F.regexp_extract(label, HAZARD_TOKEN, 1), F.lit("")))


def hazard_mosaic(df: DataFrame, bbox: tuple[float, float, float, float], label: str = "label") -> DataFrame:
    """Polygons meeting a box with their class token; the box test prunes the scan."""
    x0, y0, x1, y1 = bbox
    near = df.filter((F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0))
    return near.withColumn("hazard_class", hazard_token(F.col(label))).filter(F.col("hazard_class").isNotNull())


def flood_mosaic(layers: dict[str, DataFrame]) -> DataFrame:
    """Severity layers (found by a keyword of their name) in one table with their class."""
    out = None
    for keyword, cls in PARAMS["flood_severity"].items():
        for name in sorted(n for n in layers if "idraulica" in n.lower() and keyword in n.lower())[:1]:
            part = layers[name].withColumns({"hazard_class": F.lit(cls), "layer": F.lit(name)})
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no flood layer found")
    return out


def code_dictionary(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(code, label) rows from an object or from a list of objects with aliases."""
    text = F.trim(F.col(payload))
    as_map = F.map_entries(F.from_json(F.when(text.startswith("{"), text), "map<string,string>"))
    item = F.from_json(F.when(text.startswith("["), text), "array<map<string,string>>")
    pick = lambda m, names: F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in names])
    listed = F.transform(item, lambda m: F.struct(pick(m, ("code", "id")).alias("key"), pick(m, ("label", "name", "description")).alias("value")))
    return df.select(F.explode(F.coalesce(as_map, listed)).alias("e")).select(
        F.col("e.key").alias("code"), F.col("e.value").alias("label")
    ).dropna()


def geometry_type(dataset: Column) -> Column:
    """Geometry family from the dataset name's suffix."""
    out = None
    for suffix in GEOMETRY_SUFFIXES:
        hit = F.lower(dataset).endswith(suffix)
        out = F.when(hit, suffix) if out is None else out.when(hit, suffix)
    return out.otherwise("unknown")


def composite_inventory(rows: DataFrame, region: str, dataset: str) -> DataFrame:
    """Inventory import rows keyed by region, id and geometry family."""
    kind = geometry_type(F.lit(dataset))
    return rows.filter(F.col("id").isNotNull()).withColumns(
        {"iffi_id": F.col("id"), "region": F.lit(region), "geom_type": kind, "id": F.concat_ws("|", F.lit(region), "id", kind)}
    )


def hazard_import(old: DataFrame, new: DataFrame, national: bool) -> DataFrame:
    """Keyed merge; a national load first clears the rows that carry no version."""
    from slopewatch.operators.relational import merge_replacing

    base = old.filter(F.col("dataset_version").isNotNull()) if national else old
    return merge_replacing(base, new.filter(F.col("id").isNotNull()), ["id"])


def network_lines(features: DataFrame, class_field: str = "fclass") -> DataFrame:
    """Line strings: multi-part lines are exploded, empty ones dropped, the class is carried."""
    f = F.col("feature")
    g = F.get_json_object(f, "$.geometry")
    kind, coords = F.get_json_object(g, "$.type"), F.get_json_object(g, "$.coordinates")
    lines = F.when(kind == "LineString", F.array(F.from_json(coords, "array<array<double>>"))).when(
        kind == "MultiLineString", F.from_json(coords, "array<array<array<double>>>")
    )
    out = features.select(prop(f, class_field).alias("class"), F.posexplode(lines).alias("part", "line"))
    return out.filter(F.size("line") > 1)


def line_segments(lines: DataFrame) -> DataFrame:
    """Segment table of line strings."""
    seg = F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.struct(
        F.element_at("line", i)[0].alias("x1"), F.element_at("line", i)[1].alias("y1"),
        F.element_at("line", i + 1)[0].alias("x2"), F.element_at("line", i + 1)[1].alias("y2")))
    return lines.select(*[c for c in lines.columns if c != "line"], F.explode(seg).alias("s")).select("*", "s.*").drop("s")


def scatterers(features: DataFrame) -> DataFrame:
    """Ground-motion points; a missing acceleration stays null, a bad velocity drops the row."""
    f = F.col("feature")
    raw = prop(f, "velocity", "velocity_mmy")
    at = lambda i: F.get_json_object(f, f"$.geometry.coordinates[{i}]").try_cast("double")
    out = features.select(
        at(0).alias("lon"), at(1).alias("lat"),
        F.when(raw.isNull(), F.lit(0.0)).otherwise(raw.try_cast("double")).alias("velocity_mmy"),
        prop(f, "acceleration", "acceleration_mmy2").try_cast("double").alias("accel_mmy2"),
        short_date(prop(f, "period_start")).alias("period_start"), short_date(prop(f, "period_end")).alias("period_end"),
    )
    return out.dropna(subset=["lon", "lat", "velocity_mmy"])


def radar_pixels(df: DataFrame, value: str = "mm_h") -> DataFrame:
    """Valid pixels of a radar frame."""
    return df.filter(F.col(value) > RADAR_NODATA)


def clip_pixels(pixels: DataFrame, cells: DataFrame, half: float = 0.005, tile: float = 0.05) -> DataFrame:
    """Pixels with the cell square they fall in; tile join instead of one mask per cell."""
    from slopewatch.operators.spatial import tile_of, tiles_of_box

    keyed = cells.select("cell_id", "lon", "lat").withColumn(
        "_t", F.explode(tiles_of_box(F.col("lon") - half, F.col("lat") - half, F.col("lon") + half, F.col("lat") + half, tile))
    ).select("cell_id", "lon", "lat", F.col("_t.tx").alias("tx"), F.col("_t.ty").alias("ty"))
    at = pixels.withColumns({"tx": tile_of(F.col("x"), tile), "ty": tile_of(F.col("y"), tile)})
    inside = (F.col("x") >= F.col("lon") - half) & (F.col("x") < F.col("lon") + half) & (F.col("y") >= F.col("lat") - half) & (F.col("y") < F.col("lat") + half)
    return at.join(keyed, ["tx", "ty"]).filter(inside).drop("tx", "ty", "lon", "lat")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """Typed corpus files below a folder; unknown suffixes and blank files are left out."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))
    return typed_documents(raw)


def document_kind(name: Column) -> Column:
    out = None
    for suffix, kind in DOCUMENT_KINDS.items():
        hit = F.lower(name).endswith(suffix)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def document_title(content: Column) -> Column:
    """First non-empty line without heading marks, at most 240 characters."""
    lines = F.transform(F.split(content, r"\r\n|\r|\n"), lambda s: F.regexp_replace(s, r"^\s*#*\s*|\s+$", ""))
    return F.substring(F.get(F.filter(lines, lambda s: s != ""), F.lit(0)), 1, 240)


def typed_documents(raw: DataFrame) -> DataFrame:
    kinds = raw.withColumn("kind", document_kind(F.col("source"))).filter(F.col("kind").isNotNull() & F.col("content").rlike(r"\S"))
    stem = F.regexp_replace(F.regexp_extract("source", r"([^/]+)$", 1), r"\.[^.]+$", "")
    return kinds.withColumn("title", F.coalesce(document_title(F.col("content")), stem))


def municipalities(df: DataFrame, code: str = "pro_com", name: str = "comune") -> DataFrame:
    """Boundaries with code and name; rows without geometry are dropped."""
    return df.filter(F.col("geometry").isNotNull()).select(F.col(code).cast("string").alias("istat_code"), F.trim(name).alias("name"), "geometry")


def labelled_polygons(df: DataFrame, label: str, geometry: str = "geometry") -> DataFrame:
    """Lithology polygons: the named column, else the first text column, is the label."""
    column = label
    if column not in df.columns:
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != geometry]
        if not texts:
            raise ValueError("no label column")
        column = texts[0]
    out = df.select(F.col(column).alias("label"), geometry)
    return out.filter(F.col("label").isNotNull() & F.col(geometry).isNotNull())


def grid_candidates(boxes: DataFrame, size_m: float = 1000.0) -> DataFrame:
    """Metric grid cells over each area's extent: ids ``area|row|col``, corners and centre."""
    rows, cols = F.ceil((F.col("maxy") - F.col("miny")) / size_m), F.ceil((F.col("maxx") - F.col("minx")) / size_m)
    axis = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))
    cells = boxes.withColumn("row_idx", F.explode(axis(rows))).withColumn("col_idx", F.explode(axis(cols)))
    x0, y0 = F.col("minx") + F.col("col_idx") * size_m, F.col("miny") + F.col("row_idx") * size_m
    lon, lat = from_3035(x0 + size_m / 2, y0 + size_m / 2)
    return cells.select(
        F.concat_ws("|", "aoi_id", F.col("row_idx").cast("string"), F.col("col_idx").cast("string")).alias("cell_id"),
        "aoi_id", "row_idx", "col_idx", x0.alias("x0"), y0.alias("y0"), lon.alias("lon"), lat.alias("lat"), F.lit(size_m * size_m / 1e6).alias("area_km2"),
    )
