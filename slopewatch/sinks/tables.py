"""Writers and table maintenance on partitioned Parquet.

A merge writes the new state beside the old one and then swaps the pointer the
caller keeps, so a lost executor never leaves a half-written table behind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewatch.operators.relational import (
    content_version,
    latest_per_key,
    merge_coalescing,
    merge_replacing,
    replace_slice,
)
from slopewatch.operators.running import numbered
from slopewatch.params import PARAMS


def assessment_rows(scored: DataFrame, run_ts: Column, horizon: str | Column = "24h", pipeline: str | Column = "v1",
                    explanation: Column | None = None) -> DataFrame:
    """Rows of the assessment log; the whole run shares one time and every component is kept."""
    b = F.col("breakdown")
    factors = F.struct(
        *[b[c].alias(c) for c in "smefhk"], b["static_terms"].alias("static_terms"), b["meteo_terms"].alias("meteo_terms"),
        F.col("hard_escalation").alias("hard_escalation"),
    )
    horizon = F.lit(horizon) if isinstance(horizon, str) else horizon
    pipeline = F.lit(pipeline) if isinstance(pipeline, str) else pipeline
    kind = F.when(horizon.startswith("+"), "forecast").otherwise("observed")
    return scored.select(
        "cell_id", "aoi_id", run_ts.alias("computed_at"), horizon.alias("horizon"), kind.alias("kind"), "score", "level",
        factors.alias("factors"), (explanation if explanation is not None else F.lit(None).cast("string")).alias("explanation"),
        pipeline.alias("pipeline_version"), F.to_date(run_ts).alias("run_date"),
    )


def append_assessments(rows: DataFrame, path: str) -> None:
    """Append a run, one directory per day."""
    rows.write.mode("append").partitionBy("run_date").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def by_month(df: DataFrame, ts: str) -> DataFrame:
    """Year and month columns; partitions come into being on write."""
    return df.withColumns({"year": F.year(ts), "month": F.month(ts)})


def write_observations(df: DataFrame, path: str, ts: str = "phenomenon_time") -> None:
    by_month(df, ts).write.mode("append").partitionBy("year", "month").parquet(path)


def retention_split(df: DataFrame, ts: str, as_of: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, expired) rows for a retention period in days."""
    cut = as_of - F.make_dt_interval(days=F.lit(days))
    return df.filter(F.col(ts) >= cut), df.filter(F.col(ts) < cut)


def expired_partitions(df: DataFrame, day: str, as_of: Column, days: int) -> DataFrame:
    """Distinct day partitions to drop; rows never move."""
    return df.select(day).distinct().filter(F.col(day) < F.date_sub(as_of.cast("date"), days))


def upsert_forecast(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the forecast rows of the cells and horizons a new run brings."""
    return replace_slice(old, new, ["horizon", "cell_id"], F.col("horizon").startswith("+"))


def upsert_static(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge_coalescing(old, new, ["cell_id"], maps=["extras"] if "extras" in new.columns else [])


def upsert_samples(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Refresh features but keep a rain block that is already there."""
    prior = old.select(*keys, F.col("rain").alias("_rain"))
    kept = new.join(prior, list(keys), "left").withColumn("rain", F.coalesce("_rain", "rain")).drop("_rain")
    return merge_replacing(old, kept, keys)


def register_version(registry: DataFrame, versions: DataFrame, fetched_at: Column) -> DataFrame:
    """Append versions that differ from the latest registered one of their data set."""
    last = latest_per_key(registry, ["dataset"], ["fetched_at"]).select("dataset", F.col("version").alias("_last"))
    fresh = versions.join(last, "dataset", "left").filter(~F.col("version").eqNullSafe(F.col("_last"))).drop("_last")
    return registry.unionByName(fresh.withColumn("fetched_at", fetched_at).select(*registry.columns))


def load_if_changed(df: DataFrame, registry: DataFrame, dataset: str, load: Callable[[DataFrame], Any]) -> bool:
    """Run ``load`` unless the content equals the latest registered version.

    The driver sees two short strings.
    """
    now = content_version(df).first()
    last = registry.filter(F.col("dataset") == dataset).orderBy(F.desc("fetched_at")).select("version").first()
    if last is not None and now is not None and last["version"] == now["version"]:
        return False
    load(df)
    return True


def report_signature(zones: DataFrame, header: dict[str, Any]) -> DataFrame:
    """Order-independent hash over rounded zone values and the run's header values."""
    rounded = zones.select(*[
        F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in zones.dtypes
    ])
    v = content_version(rounded)
    head = F.to_json(F.struct(*[F.lit(x).alias(k) for k, x in sorted(header.items())]))
    return v.select(F.sha2(F.concat_ws("|", "version", "rows", head), 256).alias("signature"))


def status(registry: DataFrame) -> DataFrame:
    """Latest version row per data set."""
    return latest_per_key(registry, ["dataset"], ["fetched_at", "version"])


# --- exports --------------------------------------------------------------------
def ring_geometry(xs: Column, ys: Column) -> Column:
    """Closed polygon geometry struct of one ring."""
    pts = F.arrays_zip(xs, ys)
    closed = F.concat(pts, F.slice(pts, 1, 1))
    return F.struct(
        F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["xs"], p["ys"]))).alias("coordinates")
    )


def feature_json(df: DataFrame, geometry: Column, properties: Sequence[str], key: str) -> DataFrame:
    """One GeoJSON feature per row."""
    f = F.struct(
        F.lit("Feature").alias("type"), F.col(key).cast("string").alias("id"), geometry.alias("geometry"), F.struct(*properties).alias("properties")
    )
    return df.select(F.to_json(f).alias("value"))


def export_hazard_features(df: DataFrame, geometry: Column, path: str | None = None, key: str = "geom_id") -> DataFrame:
    """Feature lines of the known classes; one splittable text file set."""
    out = feature_json(df.filter(F.col("hazard_class").isin("AA", "P1", "P2", "P3", "P4")), geometry, ["hazard_class", "authority"], key)
    if path is not None:
        out.write.mode("overwrite").text(path)
    return out


def zone_features(members: DataFrame, half: float = 0.005) -> DataFrame:
    """(zone, rank, feature): one script-safe feature line per cell, the worst cells of a zone first.

    Ranks are running counts over slices of the score, so a zone of any size is
    ranked by many tasks.
    """
    x, y = F.col("lon"), F.col("lat")
    xs, ys = F.array(x - half, x + half, x + half, x - half), F.array(y - half, y - half, y + half, y + half)
    sliced = members.withColumns({"xs": xs, "ys": ys, "_slice": F.floor(-F.col("score") * 1000)})
    ranked = numbered(sliced, ["zone"], "_slice", [F.desc("score"), F.asc("cell_id")], "rank")
    feature = F.struct(
        F.lit("Feature").alias("type"), ring_geometry(F.col("xs"), F.col("ys")).alias("geometry"),
        F.struct("level", "cell_id", F.round("score", 3).alias("score")).alias("properties"),
    )
    return ranked.select("zone", "rank", F.replace(F.to_json(feature), F.lit("<"), F.lit("\\u003c")).alias("feature"))


def zone_collections(members: DataFrame, per_text: int = 5_000, half: float = 0.005) -> DataFrame:
    """(zone, part, parts, text): feature collections as texts of at most ``per_text`` features.

    The texts of a zone one after the other are its collection; a zone of one part
    is complete in itself. Every feature is a line of its own.
    """
    features = zone_features(members, half).withColumn("part", F.floor((F.col("rank") - 1) / per_text))
    texts = features.groupBy("zone", "part").agg(F.array_sort(F.collect_list(F.struct("rank", "feature"))).alias("_f"))
    whole = features.groupBy("zone").agg((F.max("part") + 1).alias("parts"))
    body = F.array_join(F.transform("_f", lambda f: f["feature"]), ",\n")
    head = F.when(F.col("part") == 0, '{"type":"FeatureCollection","features":[\n').otherwise(",\n")
    foot = F.when(F.col("part") == F.col("parts") - 1, "\n]}\n").otherwise("")
    same = F.col("t.zone").eqNullSafe(F.col("w.zone"))
    joined = texts.alias("t").join(whole.alias("w"), same).select("t.*", "w.parts")
    return joined.select("zone", "part", "parts", F.concat(head, body, foot).alias("text"))


def write_zone_collections(members: DataFrame, path: str, per_text: int = 5_000) -> None:
    """One folder per zone; its part files in the order of their folders' names make up the collection."""
    texts = zone_collections(members, per_text).select("zone", F.format_string("%08d", "part").alias("part"), "text")
    texts.write.mode("overwrite").partitionBy("zone", "part").text(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Manifest rows by build; a repeated build id overwrites itself only."""
    manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("build_id").json(path)


def build_index(manifests: DataFrame) -> DataFrame:
    """One row per build id, the last written wins."""
    return latest_per_key(manifests, ["build_id"], ["written_at"]).orderBy("build_id")


def prunable_builds(builds: DataFrame, keep: int | None = None) -> DataFrame:
    """Builds whose payload may go: all but the newest ``keep``."""
    n = PARAMS["zones"]["keep_builds"] if keep is None else keep
    newest = builds.select("build_id").distinct().orderBy(F.desc("build_id")).limit(n)
    return builds.select("build_id").distinct().join(newest, "build_id", "left_anti")


def instruction_rows(latest_run: DataFrame, briefings: DataFrame, instruction: str, top: int = 5) -> DataFrame:
    """(instruction, input JSON, output) per area with a briefing.

    Class counts and the best cells are partial aggregates; only the top cells
    of an area travel.
    """
    from slopewatch.operators.relational import top_per_key
    from slopewatch.operators.rollup import class_counts

    counts = latest_run.groupBy("aoi_id").agg(F.max("computed_at").alias("computed_at"), F.count(F.lit(1)).alias("celle_totali"), *class_counts())
    best = top_per_key(latest_run, ["aoi_id"], [F.desc("score"), F.asc("cell_id")], top)
    cells = best.groupBy("aoi_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "cell_id", F.round("score", 2).alias("score"), F.col("level").alias("classe")))).alias("_c")
    )
    payload = F.struct(
        F.col("aoi_id").alias("area"), F.date_format("computed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("valutato_il"), "celle_totali",
        F.struct(F.col("n_none").alias("None"), F.col("n_low").alias("Low"), F.col("n_moderate").alias("Moderate"), F.col("n_high").alias("High"), F.col("n_veryhigh").alias("VeryHigh")).alias("distribuzione_classi"),
        F.col("n_alert").alias("celle_high_o_superiori"), F.transform("_c", lambda c: c.dropFields("rank")).alias("top_celle"),
    )
    joined = counts.join(cells, "aoi_id").join(briefings, "aoi_id").filter(F.length(F.coalesce("briefing", F.lit(""))) > 0)
    return joined.select("aoi_id", F.lit(instruction).alias("instruction"), F.to_json(payload).alias("input"), F.col("briefing").alias("output"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
