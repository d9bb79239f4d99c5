"""Latest state, roll-ups by area and the ranked lists built on them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.functions.basic import argmax_name, at_least, level_of, rank_of
from slopewatch.functions.scoring import exposure_terms, land_flags
from slopewatch.operators.relational import latest_per_key, lookup_join
from slopewatch.params import LEVELS, PARAMS


def latest_state(assessments: DataFrame, observed_only: bool = False) -> DataFrame:
    """Newest assessment per cell; forecast rows can be left out explicitly."""
    rows = assessments
    if observed_only:
        rows = rows.filter(~F.col("horizon").startswith("+"))
    return latest_per_key(rows, ["cell_id"], ["computed_at", "id"])


def state_as_of(assessments: DataFrame, as_of: Column, hours_ago: int) -> DataFrame:
    """What was known ``hours_ago`` before ``as_of``, latest row per cell."""
    cut = as_of - F.make_dt_interval(hours=F.lit(hours_ago))
    return latest_state(assessments.filter(F.col("computed_at") <= cut))


def class_counts(level: str = "level") -> list[Column]:
    """One conditional count per class plus the alert count."""
    out = [F.count_if(F.col(level) == name).alias(f"n_{name.lower()}") for name in LEVELS]
    return [*out, F.count_if(F.col(level).isin("High", "VeryHigh")).alias("n_alert")]


def area_rollup(areas: DataFrame, latest: DataFrame, on: str, keep: list[str]) -> DataFrame:
    """Counts, worst class and sums per area; areas without cells stay.

    The state is aggregated before the join, so only one row per area meets
    the dimension. The seismic share of alerting cells keeps its own name.
    """
    worst = F.max_by("level", F.struct("score", (-F.col("cell_id")).alias("c")))
    sums = [F.sum(F.when(F.col("level").isin("High", "VeryHigh"), F.col(c))).alias(f"alert_{c}") for c in ("seismic", "exposure") if c in latest.columns]
    per_area = latest.filter(F.col("score").isNotNull()).groupBy(on).agg(
        F.count(F.lit(1)).alias("n_cells"), *class_counts(), F.max("score").alias("max_score"), worst.alias("worst_class"), *sums
    )
    joined = areas.select(*keep).join(per_area, on, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ["n_cells", *[f"n_{n.lower()}" for n in LEVELS], "n_alert"]}
    zero |= {f"alert_{c}": F.coalesce(F.col(f"alert_{c}"), F.lit(0.0)) for c in ("seismic", "exposure") if c in latest.columns}
    return joined.withColumns({**zero, "worst_class": F.coalesce("worst_class", F.lit("None"))})


def two_level_rollup(latest: DataFrame) -> DataFrame:
    """National, region and municipality totals in one pass."""
    return latest.rollup("aoi_id", "istat_code").agg(
        F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("n_cells"), *class_counts(), F.max("score").alias("max_score")
    )


def risk_summary(latest: DataFrame, by: str = "aoi_id") -> DataFrame:
    return latest.filter(F.col("score").isNotNull()).groupBy(by).agg(
        F.max("computed_at").alias("computed_at"), F.count(F.lit(1)).alias("cells"), F.max("score").alias("max_score"),
        F.count_if(F.col("level").isin("High", "VeryHigh")).alias("high_or_above"), F.count_if(F.col("level") == "Moderate").alias("moderate"),
    )


def top_cells(latest: DataFrame, limit: int = 10) -> DataFrame:
    """National ranking; the limit is kept within 1..100."""
    return latest.orderBy(F.desc("score"), F.asc("cell_id")).limit(max(1, min(int(limit), 100)))


def with_exposure(df: DataFrame, p: dict[str, Any] = PARAMS) -> DataFrame:
    """Append the exposure struct; expects the land-cover and network columns."""
    urban, infra = land_flags(F.col("landuse_code"))
    flag = lambda c: F.col(c) if c in df.columns else F.lit(False)
    road = F.col("nearest_road_class") if "nearest_road_class" in df.columns else F.lit(None).cast("string")
    return df.withColumn(
        "exposure",
        exposure_terms(urban, flag("near_urban"), infra, flag("near_infra"), F.col("distance_to_road_m"), F.col("distance_to_rail_m"), road, p),
    )


def alert_list(assessments: DataFrame, cells: DataFrame, static: DataFrame, as_of: Column, since_hours: int | None = None,
               minimum: str = "Moderate", limit: int | None = None, p: dict[str, Any] = PARAMS) -> DataFrame:
    """Latest alerting row per cell ranked by score times (1 + exposure).

    The window and class filters reach the scan, the per-cell maximum combines
    before its shuffle, and exposure is computed for the surviving cells only.
    """
    rows = assessments.filter(at_least("level", minimum))
    if since_hours is not None:
        rows = rows.filter(F.col("computed_at") >= as_of - F.make_dt_interval(hours=F.lit(since_hours)))
    latest = latest_per_key(rows, ["cell_id"], ["computed_at", "id"])
    placed = lookup_join(latest.join(cells, "cell_id"), static, "cell_id")
    out = with_exposure(placed, p).withColumn("priority", F.col("score") * (1.0 + F.col("exposure.factor")))
    ranked = out.orderBy(F.desc("priority"), F.asc("cell_id"))
    return ranked if limit is None else ranked.limit(limit)


def selected_for_alert(scored: DataFrame, p: dict[str, Any] = PARAMS) -> DataFrame:
    """Cells to alert: hard escalation, or over the threshold and either high or on a susceptible slope."""
    a = p["alert"]
    chosen = F.col("hard_escalation") | (
        at_least("level", a["min_level"]) & (at_least("level", "High") | (F.col("s") >= a["min_static"]))
    )
    return scored.filter(chosen)


def escalation_evidence(scored: DataFrame, k: int = 5) -> DataFrame:
    """Top cells at High or above, or escalated by movement, with their main component."""
    if k < 1:
        raise ValueError("k must be at least 1")
    parts = {name: F.coalesce(F.col(name.lower()), F.lit(0.0)) for name in ("S", "M", "E", "F", "H", "K")}
    gate = at_least("level", "High") | F.col("hard_escalation")
    return scored.filter(gate).withColumn("dominant", argmax_name(parts)).orderBy(F.desc("score"), F.asc("cell_id")).limit(k)


def shown_level(latest: DataFrame, alert: str = "High") -> DataFrame:
    """Alert level, or the highest lower level that has any cell (at least Low)."""
    top = F.max(F.when(rank_of("level") >= 1, F.least(rank_of("level"), F.lit(LEVELS.index(alert)))))
    return latest.agg(F.coalesce(top, F.lit(1)).alias("shown_rank"))


def salient(cells: DataFrame, p: dict[str, Any] = PARAMS, by: str = "aoi_id") -> tuple[DataFrame, DataFrame]:
    """(kept cells, diffuse count per area): crowded areas keep only what stands out."""
    from slopewatch.operators.running import exact_percentiles

    z = p["zones"]
    stats = exact_percentiles(cells, "score", {"background": z["reference_pct"]}, [by], also=[F.count(F.lit(1)).alias("total")])
    limits = stats.withColumn(
        "floor", F.when(F.col("total") > z["volume_trigger"], F.col("background") + z["margin"])
    )
    kept = lookup_join(cells, limits.select(by, "floor"), by, "inner").filter(F.col("floor").isNull() | (F.col("score") >= F.col("floor"))).drop("floor")
    left = kept.groupBy(by).agg(F.count(F.lit(1)).alias("kept"))
    diffuse = limits.join(left, by, "left").withColumn("kept", F.coalesce("kept", F.lit(0))).withColumn("diffuse", F.col("total") - F.col("kept"))
    return kept, diffuse


def frequency_against_target(latest: DataFrame, p: dict[str, Any] = PARAMS) -> DataFrame:
    """Achieved share per class next to the target share."""
    target = latest.sparkSession.createDataFrame(list(p["target_share"].items()), "level string, target double")
    total = latest.agg(F.count(F.lit(1)).alias("n")).scalar()
    got = latest.groupBy("level").agg((F.count(F.lit(1)) / total).alias("achieved"))
    return target.join(got, "level", "left").withColumn("achieved", F.coalesce("achieved", F.lit(0.0))).withColumn(
        "gap", F.col("achieved") - F.col("target")
    )


def with_level(df: DataFrame, score: str = "score", name: str = "level") -> DataFrame:
    return df.withColumn(name, level_of(score))
