"""Offline jobs: static bootstrap, calibration, backtest, training enrichment, export."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.basic import at_least
from slopewatch.functions.scoring import INPUT_COLUMNS, hazard_norm, lithology_weight, rain_excess, score, static_component, static_terms
from slopewatch.operators import spatial as X
from slopewatch.operators import zonal as Z
from slopewatch.operators.evaluation import backtest_gate, backtest_scores
from slopewatch.operators.learning import guarded_corr
from slopewatch.operators.relational import lookup_join, sized_join
from slopewatch.operators.segments import nearest_segment
from slopewatch.operators.timeseries import antecedent_rain
from slopewatch.params import PARAMS
from slopewatch.session import cut_lineage


def static_factors(cells: DataFrame, inventory: DataFrame, hazard_edges: DataFrame, hazards: DataFrame, network: DataFrame,
                   faults: DataFrame | None = None, pixels: DataFrame | None = None, cellsize: float = 100.0,
                   p: dict[str, Any] = PARAMS) -> DataFrame:
    """Static factors of every cell: inventory density and distance, hazard, lithology, roads, terrain."""
    reach = p["search_radius_m"] / 111_320.0
    out = X.count_within(cells, inventory.select("x", "y"), reach).select("cell_id", F.col("n").cast("double").alias("iffi_density_500"))
    out = out.join(X.nearest_feature(cells, inventory.select("x", "y"), p["distance_cap_m"]).withColumnRenamed("dist_m", "distance_to_iffi_m"), "cell_id")
    touch = sized_join(X.polygons_touching_cells(cells, hazard_edges), hazards.select("geom_id", "hazard_class"), "geom_id")
    worst = touch.groupBy("cell_id").agg(F.max(hazard_norm(F.col("hazard_class"))).alias("pai_class_norm"))
    label = Z.dominant_label(Z.overlap_areas(cells, hazard_edges), hazards.select("geom_id", "label"))
    out = out.join(worst, "cell_id", "left").join(label.select("cell_id", lithology_weight(F.col("label")).alias("litho_weight")), "cell_id", "left")
    for kind in ("road", "rail"):
        lines = network.filter(F.col("kind") == kind).select("x", "y", "class")
        d = X.nearest_feature(cells, lines, p["distance_cap_m"], keep="class").withColumnRenamed("dist_m", f"distance_to_{kind}_m")
        out = out.join(d.withColumnRenamed("class", "nearest_road_class") if kind == "road" else d.drop("class"), "cell_id")
    if faults is not None:
        out = out.join(nearest_segment(cells, faults).withColumnRenamed("dist_m", "distance_to_fault_m"), "cell_id")
    if pixels is not None:
        out = out.join(Z.terrain_stats(pixels, cellsize).filter(F.col("pixel_count") > 0).drop("pixel_count"), "cell_id", "left")
    return out


def calibrate(static: DataFrame, cells: DataFrame, p: dict[str, Any] = PARAMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(min/max per area and factor, static score per cell, correlation with susceptibility per area)."""
    factors = ["susc_ispra", "iffi_density_500", "slope_deg", "pai_class_norm", "litho_weight"]
    placed = lookup_join(static, cells.select("cell_id", "aoi_id"), "cell_id", "inner")
    long = placed.unpivot(["aoi_id"], factors, "factor", "v").filter(F.col("v").isNotNull())
    norms = long.groupBy("aoi_id", "factor").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    s = placed.withColumn("_t", static_terms(p)).select("cell_id", "aoi_id", "susc_ispra", static_component(F.col("_t"), p).alias("s_static"))
    fit = s.groupBy("aoi_id").agg(F.count("susc_ispra").alias("n"), guarded_corr("s_static", "susc_ispra", 3).alias("r"))
    return norms, s.select("cell_id", "s_static"), fit


HOUR = 3_600_000_000
UNIT = 1_000_000_000_000  # rain is summed in whole units, so that differences of running sums are exact


def event_states(rain: DataFrame, key: str, p: dict[str, Any], slice_hours: float, hours: int) -> DataFrame:
    """Samples (key, _slice, us, units, wet, seq, c, last, begun, before) by time slice.

    A slice begins with the samples of the ``hours`` before it, so its windows need nothing of other
    slices. ``c`` is the rain up to a sample since the slice's first, ``last`` the wet sample before it (seq, us, c), ``begun``
    its event (start_us, c0), ``before`` the last earlier event of enough rain (start_us, c0, end_us, c1).
    """
    gap, least = p["rain_event"]["dry_samples"], int(p["rain_event"]["min_mm"] * UNIT)
    width = int(slice_hours * HOUR)
    base = rain.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.round(F.col("mm") * UNIT).cast("bigint").alias("units"))
    seen_by = F.sequence(F.floor(F.col("us") / width), F.floor((F.col("us") + hours * HOUR) / width))
    order = Window.partitionBy(key, "_slice").orderBy("us", "units")
    upto, back = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    s = base.withColumn("_slice", F.explode(seen_by)).withColumns({"wet": F.coalesce(F.col("units") > 0, F.lit(False)), "seq": F.row_number().over(order)})
    s = s.withColumn("c", F.sum(F.when(F.col("wet"), F.col("units")).otherwise(0)).over(upto))
    s = s.withColumn("last", F.max(F.when(F.col("wet"), F.struct("seq", "us", "c"))).over(back))
    opens = F.col("wet") & (F.col("last").isNull() | (F.col("seq") - F.col("last.seq") - 1 >= gap))
    begun = F.when(opens, F.struct(F.col("us").alias("start_us"), (F.col("c") - F.col("units")).alias("c0")))
    s = s.withColumns({"begun": F.max(begun).over(upto), "_prior": F.max(begun).over(back)})
    ended = F.struct("_prior.start_us", "_prior.c0", F.col("last.us").alias("end_us"), F.col("last.c").alias("c1"))
    enough = opens & (F.col("last.c") - F.col("_prior.c0") >= least)
    return s.withColumn("before", F.max(F.when(enough, ended)).over(upto)).drop("_prior")


def node_hours(rain: DataFrame, axis: DataFrame, hours: int = 48, key: str = "node_id", p: dict[str, Any] = PARAMS, slice_hours: float = 720.0) -> DataFrame:
    """Latest rain event per node and evaluation hour over the trailing ``hours``, and the rain of 24 hours.

    Only samples are moved, once, with the slice they fall into. What an hour sees changes where a sample comes or
    leaves one of the two windows; between two changes it is the same for all hours, which are put in last.
    What lies before the window is taken off an event; if too little is left, the last earlier event of enough
    rain stands, as far as the window reaches it. Hours without any sample in their window have no row.
    """
    least, width = int(p["rain_event"]["min_mm"] * UNIT), int(slice_hours * HOUR)
    s = event_states(rain, key, p, slice_hours, hours)
    us, wet = F.col("us"), F.col("wet")
    now = F.struct("seq", us.alias("seen"), F.when(wet, us).otherwise(F.col("last.us")).alias("us"), "c", "begun", "before")
    old = F.struct(F.col("last.c").alias("c"), us.alias("next_us"))  # the first wet sample after those that left
    none = lambda c: F.lit(None).cast(s.select(c.alias("x")).schema["x"].dataType)
    change = lambda at, n, c24, o: F.struct(at.alias("pos"), n.alias("now"), c24.alias("c24"), o.alias("old"))
    changes = F.array(
        change(us, now, none(F.col("c")), none(old)),
        F.when(wet, change(us + (24 * HOUR + 1), none(now), F.col("c"), none(old))),
        F.when(wet, change(F.col("last.us") + (hours * HOUR + 1), none(now), none(F.col("c")), old)),
    )
    order = Window.partitionBy(key, "_slice").orderBy("pos", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    told = s.select(key, "_slice", "seq", F.explode(changes).alias("x")).filter("x.pos is not null").select(key, "_slice", "seq", "x.*")
    told = told.select(key, "_slice", "pos", F.lead("pos").over(order).alias("next"), *[F.max(c).over(upto).alias(c) for c in ("now", "c24", "old")])
    ends = F.least("next", (F.col("_slice") + 1) * width, F.col("now.seen") + (hours * HOUR + 1))  # skips nulls
    told = told.withColumns({"_from": F.greatest(F.col("pos"), F.col("_slice") * width), "_to": ends}).filter("_from < _to")
    told = told.withColumn("_hour", F.explode(F.sequence(F.floor(F.col("_from") / HOUR), F.floor((F.col("_to") - 1) / HOUR))))
    asked = axis.select("t", F.unix_micros(F.col("t").cast("timestamp")).alias("at")).filter("at is not null").distinct()  # a bounded list of hours
    at = F.col("at")
    j = told.join(F.broadcast(asked.withColumn("_hour", F.floor(at / HOUR))), "_hour").filter((at >= F.col("_from")) & (at < F.col("_to")))

    bound, cut = at - hours * HOUR, F.coalesce("old.c", F.lit(0))
    begin = lambda start: F.when(start >= bound, start).otherwise(F.col("old.next_us"))
    part = lambda start, c0, end, c1: F.struct((c1 - F.greatest(c0, cut)).alias("units"), begin(start).alias("a"), end.alias("b"))
    whole = part(F.col("now.begun.start_us"), F.col("now.begun.c0"), F.col("now.us"), F.col("now.c"))
    prior = part(*[F.col(f"now.before.{c}") for c in ("start_us", "c0", "end_us", "c1")])
    use = lambda e: F.when((e["b"] >= bound) & (e["units"] >= least), e)
    j = j.withColumn("e", F.coalesce(use(whole), use(prior)))
    r24 = F.when(F.col("now.seen") >= at - 24 * HOUR, (F.col("now.c") - F.coalesce("c24", F.lit(0))) / F.lit(float(UNIT)))
    return j.select(
        key, "t", r24.alias("rain_24h_mm"), (F.col("e.units") / F.lit(float(UNIT))).alias("event_mm"),
        F.greatest(F.lit(1.0), (F.col("e.b") - F.col("e.a")) / 3.6e9 + 1.0).alias("event_hours"),
    ).withColumn("event_hours", F.when(F.col("event_mm").isNotNull(), F.col("event_hours")))


def alert_hours(placed: DataFrame, states: DataFrame, minimum: str, p: dict[str, Any] = PARAMS) -> DataFrame:
    """(cell_id, ts, hours): first alert hour and number of alert hours of every cell with any.

    ``states(node_id, caine_excess, ts, hours)``. A score does not fall with the excess, so the alert
    states of a cell are the first ones of its node by falling excess. How many they are is found by
    halving: a cell is scored once per bit of the largest number of states.
    """
    falling = Window.partitionBy("node_id").orderBy(F.desc("caine_excess"))  # at most one state an hour
    upto = falling.rowsBetween(Window.unboundedPreceding, 0)
    each = states.groupBy("node_id", "caine_excess").agg(F.min("ts").alias("ts"), F.sum("hours").alias("hours"))
    ladder = cut_lineage(each.select("node_id", F.row_number().over(falling).alias("rank"), "caine_excess", F.min("ts").over(upto).alias("ts"), F.sum("hours").over(upto).alias("hours")))
    most = ladder.agg(F.max("rank")).first()[0] or 0
    inputs = {*INPUT_COLUMNS, "macroregion"} - {"caine_excess"}
    own = ["cell_id", "node_id", *[c for c in placed.columns if c in inputs]]
    found = placed.select(*own, F.lit(0).alias("reached"))
    for bit in reversed(range(most.bit_length())):
        tried = found.withColumn("rank", F.col("reached") + (1 << bit)).join(ladder.select("node_id", "rank", "caine_excess"), ["node_id", "rank"], "left")
        alert = F.col("caine_excess").isNotNull() & at_least("level", minimum)
        found = score(tried, p).select(*own, F.when(alert, F.col("rank")).otherwise(F.col("reached")).alias("reached"))
    return found.join(ladder.withColumnRenamed("rank", "reached"), ["node_id", "reached"]).select("cell_id", "ts", "hours")


def backtest(cells: DataFrame, static: DataFrame, rain: DataFrame, axis: DataFrame, truth: DataFrame, minimum: str = "Moderate",
             lead_max_h: float = 120.0, p: dict[str, Any] = PARAMS) -> DataFrame:
    """One row of skill for a replay: every hour of the axis for every cell, first alert per cell.

    Hours in which a node's features are the same score the same, so they are one
    state with their number and the first of them. Only nodes with cells are replayed. A cell
    halves its node's states by excess; with snow cover, where rain of a day counts too, it meets them all.
    """
    placed = cells.select("cell_id", "node_id").join(static, "cell_id")
    snow = "snow_depth_m" in placed.columns
    seen = ["event_mm", "event_hours"] + (["rain_24h_mm"] if snow else [])
    rain = rain.join(cells.select("node_id").distinct(), "node_id", "left_semi")
    states = node_hours(rain, axis, p=p).groupBy("node_id", *seen).agg(F.min("t").alias("ts"), F.count(F.lit(1)).alias("hours"))
    states = states.withColumn("caine_excess", rain_excess(F.col("event_mm"), F.col("event_hours"), F.lit("italy_default")))
    rising = min(p["meteo_weights"]["caine"], p["component_weights"]["m"], 1 - p["kinematic"]["weight"]) >= 0
    if rising and not snow:
        alerts = alert_hours(placed, states, minimum, p)
    else:
        b = placed.drop("caine_excess").join(states, "node_id")
        alerts = score(b, p).filter(at_least("level", minimum)).select("cell_id", "ts", "hours")
    return backtest_gate(backtest_scores(alerts, truth, lead_max_h, F.col("hours")), p)


def enrich_samples(samples: DataFrame, rain: DataFrame, last_covered: Any) -> DataFrame:
    """Antecedent rain for samples lacking it; those past the archive's end stay as they are."""
    pending = samples.filter(F.col("rain").isNull() & (F.col("valuation_time") <= last_covered)).drop("rain")
    got = antecedent_rain(pending, rain, key="node_id", at="valuation_time")
    block = F.struct("rain_24h_mm", "rain_72h_mm", "rain_30d_mm", "max_i_24h_mmh", "degraded").alias("rain")
    done = got.select(*pending.columns, block)
    rest = samples.filter(~(F.col("rain").isNull() & (F.col("valuation_time") <= last_covered)))
    return done.unionByName(rest.select(*done.columns))


def feature_export(cells: DataFrame, inventory: DataFrame, hazard_edges: DataFrame, hazards: DataFrame, store: DataFrame) -> DataFrame:
    """Export variant: geodesic density, hazard on the chosen ladder, merged into the store without erasing."""
    from slopewatch.operators.relational import merge_coalescing

    density = X.count_within_m(cells, inventory.select("x", "y"), 500.0).select("cell_id", F.least(F.col("n") / 3.0, F.lit(1.0)).alias("iffi_density_500"))
    touch = sized_join(X.polygons_touching_cells(cells, hazard_edges), hazards.select("geom_id", "hazard_class"), "geom_id")
    worst = touch.groupBy("cell_id").agg(F.max(hazard_norm(F.col("hazard_class"), "export")).alias("pai_class_norm"))
    new = cells.select("cell_id").join(density, "cell_id", "left").join(worst, "cell_id", "left")
    return merge_coalescing(store, new, ["cell_id"])
