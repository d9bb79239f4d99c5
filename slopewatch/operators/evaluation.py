"""Model evaluation: skill scores, calibration, drift and verification."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.operators.running import cumulative_by_value, exact_percentiles
from slopewatch.params import PARAMS


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(y: Column, hit: Column) -> dict[str, Column]:
    """Aggregates tp, fp, fn, tn of a 0/1 label against a boolean alarm."""
    return {
        "tp": F.count_if(hit & (y == 1)), "fp": F.count_if(hit & (y == 0)),
        "fn": F.count_if(~hit & (y == 1)), "tn": F.count_if(~hit & (y == 0)),
    }


def skill(counts: DataFrame) -> DataFrame:
    """hit_rate, far, sensitivity, specificity and tss from confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {"hit_rate": ratio(tp, tp + fn), "far": ratio(fp, fp + tp), "specificity": ratio(tn, tn + fp)}
    ).withColumns({"sensitivity": F.col("hit_rate"), "tss": F.col("hit_rate") + F.col("specificity") - 1.0})


def skill_at(df: DataFrame, threshold: float, y: str = "label", p: str = "prob", by: tuple[str, ...] = ()) -> DataFrame:
    counts = confusion(F.col(y), F.col(p) >= threshold)
    return skill(df.groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()]))


def average_precision(df: DataFrame, y: str = "label", p: str = "prob", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under precision-recall: recall steps times precision, from high scores to low."""
    runs = cumulative_by_value(
        df, p, {"n": F.lit(1).cast("bigint"), "pos": (F.col(y) == 1).cast("bigint")}, by, descending=True
    )
    return runs.groupBy(*by).agg(
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("_s"), F.sum("pos").alias("_p")
    ).select(*by, ratio(F.col("_s"), F.col("_p")).alias("average_precision"))


def operating_points(df: DataFrame, targets: tuple[float, ...] = (0.5, 0.7, 0.9), y: str = "label", p: str = "prob") -> DataFrame:
    """Skill at the highest thresholds that still catch each share of the positives."""
    positives = df.filter(F.col(y) == 1)
    wide = exact_percentiles(positives, p, {f"q{i}": 1.0 - t for i, t in enumerate(targets)})
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("recall_target"), F.coalesce(F.col(f"q{i}"), F.lit(1.0)).alias("threshold"))
        for i, t in enumerate(targets)
    ])
    points = wide.select(F.explode(rows).alias("r")).select("r.*")
    # three thresholds, so the pass over the data carries one flag per target
    cuts = df.withColumn("_t", F.array(*[F.coalesce(wide.select(f"q{i}").scalar(), F.lit(1.0)) for i in range(len(targets))]))
    flags = cuts.select(F.col(y).alias("y"), F.posexplode(F.transform("_t", lambda t: F.col(p) >= t)).alias("i", "hit"))
    counts = flags.groupBy("i").agg(*[c.alias(n) for n, c in confusion(F.col("y"), F.col("hit")).items()])
    named = points.withColumn("i", F.array_position(F.array(*[F.lit(float(t)) for t in targets]), F.col("recall_target")).cast("int") - 1)
    return skill(named.join(counts, "i").drop("i"))


def conformal_quantiles(df: DataFrame, alphas: tuple[float, ...] = (0.2, 0.1, 0.05), y: str = "label", p: str = "prob") -> DataFrame:
    """Error quantiles at the finite-sample corrected rank, one column per level."""
    errors = df.select(F.abs(F.col(y) - F.col(p)).alias("err"))
    runs = cumulative_by_value(errors, "err", {"n": F.lit(1).cast("bigint")}).withColumn(
        "_size", errors.agg(F.count(F.lit(1)).alias("c")).scalar()
    )
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    aggs, outs = [], []
    for a in alphas:
        name = f"q{int((1 - a) * 100)}"
        rank = F.least(F.lit(1.0), F.ceil((F.col("_size") + 1) * F.lit(1 - a)) / F.col("_size"))
        k = (F.col("_size") - 1) * rank
        aggs += [
            F.max(F.when(F.floor(k).between(first, last), F.col("err"))).alias(f"_l{name}"),
            F.max(F.when(F.ceil(k).between(first, last), F.col("err"))).alias(f"_h{name}"),
            F.max(k - F.floor(k)).alias(f"_w{name}"),
        ]
        lo, hi, w = F.col(f"_l{name}"), F.col(f"_h{name}"), F.col(f"_w{name}")
        outs.append((lo + (hi - lo) * w).alias(name))
    return runs.agg(*aggs).select(*outs)


def reliability_bins(df: DataFrame, p: str = "prob", seen: str = "observed", bins: int = 10,
                     min_positives: int | None = None) -> DataFrame:
    """Calibration table; empty bins are absent, and too few positives give no rows."""
    index = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(p) * bins))).cast("int")
    out = df.groupBy(index.alias("bin")).agg(
        F.avg(p).alias("predicted_mean"), F.avg(F.col(seen).cast("int")).alias("observed_freq"), F.count(F.lit(1)).alias("n")
    ).select(
        "bin", (F.col("bin") / bins).alias("lo"), ((F.col("bin") + 1) / bins).alias("hi"), "predicted_mean", "observed_freq", "n"
    )
    if min_positives is not None:
        enough = df.agg((F.count_if(F.col(seen).cast("boolean")) >= min_positives).alias("ok")).scalar()
        out = out.filter(enough)
    return out


# --- drift --------------------------------------------------------------------
def psi_edges(reference: DataFrame, value: str, buckets: int = 10) -> DataFrame:
    """One row with the reference values at ranks floor(i/buckets*(n-1))."""
    runs = cumulative_by_value(reference, value, {"n": F.lit(1).cast("bigint")}).withColumn(
        "_size", reference.agg(F.count(F.lit(1)).alias("c")).scalar()
    )
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    at = lambda i: F.floor(F.lit(i / buckets) * (F.col("_size") - 1))
    return runs.agg(*[F.max(F.when(at(i).between(first, last), F.col(value))).alias(f"e{i}") for i in range(buckets + 1)]).select(
        F.array(*[f"e{i}" for i in range(buckets + 1)]).alias("edges")
    )


def population_stability(reference: DataFrame, candidate: DataFrame, value: str = "v", buckets: int = 10) -> DataFrame:
    """Stability index on reference deciles; values outside the edges do not count."""
    edges = psi_edges(reference, value, buckets).scalar()
    both = reference.select(F.col(value).alias("v"), F.lit(0).alias("src")).unionByName(
        candidate.select(F.col(value).alias("v"), F.lit(1).alias("src"))
    ).withColumn("_e", edges)
    v, e = F.col("v"), F.col("_e")
    inside = v.between(e[0], e[buckets])
    index = F.least(F.size(F.filter(e, lambda x: x <= v)) - 1, F.lit(buckets - 1))
    counts = both.filter(inside).groupBy(index.alias("b")).agg(
        F.count_if(F.col("src") == 0).alias("nr"), F.count_if(F.col("src") == 1).alias("nc")
    )
    # at most one row per bucket; a bucket empty on both sides adds nothing
    whole = Window.partitionBy(F.lit(0))
    share = lambda c: F.greatest(F.lit(1e-6), F.col(c) / F.greatest(F.lit(1), F.sum(c).over(whole)))
    shares = counts.select(share("nr").alias("r"), share("nc").alias("q"))
    term = (F.col("q") - F.col("r")) * (F.log("q") - F.log("r"))
    return shares.agg(F.greatest(F.lit(0.0), F.coalesce(F.sum(term), F.lit(0.0))).alias("psi"))


def ks_distance(reference: DataFrame, candidate: DataFrame, value: str = "v") -> DataFrame:
    """Largest gap between the two empirical distribution functions."""
    both = reference.select(F.col(value).alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(
        candidate.select(F.col(value).alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c"))
    )
    runs = cumulative_by_value(both, "v", {"nr": F.col("r"), "nc": F.col("c")})
    nr, nc = reference.agg(F.count(F.lit(1)).alias("c")).scalar(), candidate.agg(F.count(F.lit(1)).alias("c")).scalar()
    gap = F.abs(F.col("cum_nr") / nr - F.col("cum_nc") / nc)
    return runs.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


def drift_report(reference: DataFrame, candidate: DataFrame, value: str, ref_prob: str, cand_prob: str,
                 new_events: int = 0, p: dict[str, Any] = PARAMS) -> DataFrame:
    """One row: the three distances, their alarms and the retraining decision."""
    d = p["drift"]
    pred = F.abs(
        candidate.agg(F.avg(cand_prob).alias("a")).scalar() - reference.agg(F.avg(ref_prob).alias("a")).scalar()
    )
    row = population_stability(reference, candidate, value).select(
        "psi", ks_distance(reference, candidate, value).scalar().alias("ks"), F.coalesce(pred, F.lit(0.0)).alias("pred_drift")
    )
    return retrain_decision(row.withColumn("new_events", F.lit(new_events)), d)


def retrain_decision(row: DataFrame, d: dict[str, Any] = PARAMS["drift"]) -> DataFrame:
    """First signal in the order stability, distance, prediction, new events decides."""
    reason = (
        F.when(F.col("psi") >= d["psi"], "psi").when(F.col("ks") >= d["ks"], "ks")
        .when(F.col("pred_drift") >= d["prediction"], "prediction").when(F.col("new_events") >= d["new_events"], "new_events")
        .otherwise("none")
    )
    return row.withColumn("reason", reason).withColumn("should_retrain", F.col("reason") != "none")


# --- backtest and verification --------------------------------------------------
def backtest_scores(alerts: DataFrame, truth: DataFrame, lead_max_h: float = 120.0, times: Column | None = None) -> DataFrame:
    """Skill of first alerts per cell against the first event per cell.

    ``alerts(cell_id, ts)``, ``truth(cell_id, event_time)``. Only the first
    alert of a cell counts, as in operation. An alert row may stand for several
    ``times``, of which ``ts`` is the first.
    """
    first_alert = alerts.groupBy("cell_id").agg(F.min("ts").alias("alert_ts"), F.sum(F.lit(1) if times is None else times).alias("_n"))
    first_event = truth.groupBy("cell_id").agg(F.min("event_time").alias("event_time"))
    lead = (F.unix_micros(F.col("event_time").cast("timestamp")) - F.unix_micros(F.col("alert_ts").cast("timestamp"))) / 3.6e9
    joined = first_event.join(first_alert, "cell_id", "full_outer").withColumn("lead", lead)
    hit = F.coalesce((F.col("lead") > 0) & (F.col("lead") <= lead_max_h), F.lit(False))
    out = joined.agg(
        F.count("event_time").alias("events"), F.count("alert_ts").alias("alerted_cells"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("alerts"), F.count_if(hit).alias("hits"),
        F.avg(F.when(hit, F.col("lead"))).alias("_lead"),
    )
    fa = F.greatest(F.lit(0), F.col("alerted_cells") - F.col("hits"))
    return out.withColumns({"misses": F.col("events") - F.col("hits"), "false_alarms": fa}).withColumns(
        {
            "hit_rate": ratio(F.col("hits"), F.col("events")),
            "far": ratio(F.col("false_alarms"), F.col("hits") + F.col("false_alarms")),
            "mean_lead_h": F.coalesce("_lead", F.lit(0.0)),
        }
    ).drop("_lead")


def backtest_gate(scores: DataFrame, p: dict[str, Any] = PARAMS) -> DataFrame:
    g = p["promotion"]
    ok = (F.col("hit_rate") >= g["hit_rate"]) & (F.col("far") <= g["false_alarm_rate"]) & (F.col("mean_lead_h") >= g["lead_hours"])
    return scores.withColumn("accepted", ok)


def promotion_gate(metrics: DataFrame, p: dict[str, Any] = PARAMS) -> DataFrame:
    """Every floor must clear and the challenger must beat the baseline."""
    g = p["promotion"]
    ok = (
        (F.col("average_precision") >= g["average_precision"]) & (F.col("brier") <= g["brier"])
        & (F.col("hit_rate") >= g["hit_rate"]) & (F.col("far") <= g["false_alarm_rate"])
        & (F.col("mean_lead_h") >= g["lead_hours"]) & (F.col("average_precision") > F.col("baseline_ap"))
    )
    return metrics.withColumn("promoted", ok)


def zone_verification(hit_zones: DataFrame, matched: DataFrame, zones: DataFrame, area_events: DataFrame) -> DataFrame:
    """One row: detection, false-alarm share and lead of a build's zones.

    ``hit_zones(zone)`` have an event within reach, ``matched(event_id)`` a zone;
    ``zones(zone)``, ``area_events(event_id, lead_h)``.
    """
    outcomes = zones.select("zone").distinct().join(hit_zones.select("zone").distinct().withColumn("_hit", F.lit(True)), "zone", "left")
    z = outcomes.agg(F.count(F.lit(1)).alias("n_zones"), F.count_if(F.col("_hit").isNull()).alias("false_alarm_zones"))
    detected = matched.select("event_id").distinct().withColumn("_d", F.lit(1))
    # a matched event outside the areas still counts as matched
    seen = area_events.join(detected, "event_id", "full_outer")
    e = seen.agg(
        F.count_if(F.col("lead_h").isNotNull()).alias("n_events"),
        F.count("_d").alias("matched"),
        F.count_if(F.col("lead_h").isNotNull() & F.col("_d").isNull()).alias("missed"),
        F.avg(F.when(F.col("_d").isNotNull(), F.col("lead_h"))).alias("mean_lead_h"),
    )
    names = e.columns
    both = z.withColumn("_e", e.select(F.struct(*names)).scalar()).select("*", "_e.*").drop("_e")
    return both.withColumns(
        {"pod": ratio(F.col("matched"), F.col("n_events")), "far": ratio(F.col("false_alarm_zones"), F.col("n_zones"))}
    )
