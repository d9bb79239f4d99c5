"""Shadow comparison, zone report and national report."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.functions.basic import build_id, rank_of
from slopewatch.functions.text import region_title
from slopewatch.operators import components as C
from slopewatch.operators import rollup as U
from slopewatch.operators.relational import lookup_join
from slopewatch.operators.timeseries import trend
from slopewatch.params import PARAMS
from slopewatch.sinks.tables import report_signature


def zone_report(latest: DataFrame, log: DataFrame, as_of: Column, diffuse_ok: bool = True, p: dict[str, Any] = PARAMS) -> tuple[DataFrame, DataFrame]:
    """(manifest rows of the shown zones with their trend, one-row signature).

    The shown level steps down until cells exist, crowded areas keep what stands
    out, zones are ranked and capped.
    """
    z = p["zones"]
    level = U.shown_level(latest).scalar()
    shown = latest.filter(rank_of("level") >= level)
    kept, diffuse = U.salient(shown, p)
    members = C.zones(kept.select("cell_id", "aoi_id", "lon", "lat", "score", "level"), z["eps_deg"])
    ranked = C.zone_summary(members).orderBy(F.desc("max_score"), "dominant_cell").limit(z["max_zones"])
    points = trend(log, as_of).withColumnRenamed("cell_id", "dominant_cell")
    lines = points.join(F.broadcast(ranked.select("dominant_cell")), "dominant_cell", "left_semi").groupBy("dominant_cell").agg(
        F.array_sort(F.collect_list(F.struct("kind", "t", F.round("score", 6).alias("score")))).alias("trend")
    )
    manifest = ranked.join(lines, "dominant_cell", "left").withColumns({"build_id": build_id(as_of), "valuation_time": as_of})
    if diffuse_ok:
        manifest = manifest.withColumn("diffuse_cells", diffuse.agg(F.coalesce(F.sum("diffuse"), F.lit(0))).scalar())
    signature = report_signature(ranked.select("aoi_id", "zone", "n_cells", "max_score", "level"), {"shown": "zones"})
    return manifest, signature


def national_report(latest: DataFrame, areas: DataFrame, ml_top: DataFrame, alerts: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row: totals, hot regions, best cells and the wording built from them."""
    regions = U.risk_summary(latest)
    named = lookup_join(regions, areas.select("aoi_id", "name"), "aoi_id")
    hot = F.filter(F.array_sort(F.collect_list(F.struct((-F.col("high_or_above")).alias("o"), region_title(F.col("aoi_id")).alias("region"), "high_or_above"))), lambda r: r["high_or_above"] > 0)
    totals = named.agg(
        F.count(F.lit(1)).alias("regions"), F.sum("cells").alias("cells"), F.sum("high_or_above").alias("high_or_above"), F.sum("moderate").alias("moderate"), hot.alias("hot")
    )
    top = U.top_cells(latest, 10).agg(F.max(F.struct("score", "cell_id")).alias("top"))
    best_ml = ml_top.agg(F.max(F.struct("probability", "cell_id")).alias("m"))
    row = totals.withColumns(
        {
            "top": top.scalar(), "ml_top": best_ml.scalar(),
            "alerts": alerts.agg(F.count(F.lit(1)).alias("n")).scalar(), "forecasts": forecasts.agg(F.count(F.lit(1)).alias("n")).scalar(),
        }
    )
    where = F.array_join(F.transform(F.slice("hot", 1, 5), lambda r: F.concat(r["region"], F.lit(" ("), r["high_or_above"].cast("string"), F.lit(")"))), ", ")
    lead = F.when(F.col("high_or_above") > 0, F.format_string("%d zone a rischio alto o molto alto: %s.", F.col("high_or_above"), where)).otherwise(
        "Nessuna zona è a rischio alto in questo momento."
    )
    return row.withColumn(
        "report",
        F.concat_ws(
            "\n", lead,
            F.format_string("%d aree mostrano un rischio moderato, su %d monitorate in %d regioni.", F.col("moderate"), F.col("cells"), F.col("regions")),
            F.format_string("Punto da tenere d'occhio: %s (punteggio %.2f).", F.col("top.cell_id").cast("string"), F.col("top.score")),
            F.format_string("Allerte operative: %d, previsionali: %d.", F.col("alerts"), F.col("forecasts")),
        ),
    )
