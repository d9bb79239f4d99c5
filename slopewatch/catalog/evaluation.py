"""Queries over skill scores, calibration, drift, backtests and the training set."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.catalog.registry import Frames, query
from slopewatch.catalog.rollups import r6
from slopewatch.catalog.scoring import BLEND, EXCESS, bundle
from slopewatch.functions import basic as B
from slopewatch.functions import scoring as S
from slopewatch.operators import evaluation as E
from slopewatch.operators import learning as L
from slopewatch.operators.relational import lookup_join
from slopewatch.operators.running import exact_percentiles

CONF = "count(*) filter (where prob >= {t} and label = 1) as tp, count(*) filter (where prob >= {t} and label = 0) as fp, count(*) filter (where prob < {t} and label = 1) as fn, count(*) filter (where prob < {t} and label = 0) as tn"
HIT, FAR, SPEC = "coalesce(tp / nullif(tp + fn, 0), 0)", "coalesce(fp / nullif(fp + tp, 0), 0)", "coalesce(tn / nullif(tn + fp, 0), 0)"


@query("agg19_hit_and_false_alarm", f"with c as (select {CONF.format(t=0.5)} from fx_scored) select round({HIT}, 6) as hit_rate, round({FAR}, 6) as far from c")
def _(fx):
    return E.skill_at(fx["fx_scored"], 0.5).select(r6(F.col("hit_rate"), "hit_rate"), r6(F.col("far"), "far"))


@query("agg20_true_skill", f"with c as (select split_block, {CONF.format(t=0.4)} from fx_scored group by split_block) select split_block, tp, fp, fn, tn, round({HIT} + {SPEC} - 1, 6) as tss, round({HIT}, 6) as sensitivity, round({SPEC}, 6) as specificity from c")
def _(fx):
    out = E.skill_at(fx["fx_scored"], 0.4, by=("split_block",))
    return out.select("split_block", "tp", "fp", "fn", "tn", *[r6(F.col(c), c) for c in ("tss", "sensitivity", "specificity")])


@query("agg21_mean_lead", "select round(coalesce(avg(d) filter (where hit and d > 0), 0), 4) as lead_h from (select e.cell_id, (epoch_us(e.event_time) - epoch_us(a.computed_at)) / 3.6e9 as d, a.score > 0.5 as hit from fx_truth e join fx_assess a on a.id = e.event_id) t")
def _(fx):
    j = fx["fx_truth"].join(fx["fx_assess"], F.col("event_id") == F.col("id"))
    d = B.hours_between("event_time", "computed_at")
    return j.agg(F.round(F.coalesce(F.avg(F.when((F.col("score") > 0.5) & (d > 0), d)), F.lit(0.0)), 4).alias("lead_h"))


@query("agg22_average_precision", """with v as (select prob, count(*) as n, sum(label) as pos from fx_scored group by prob), c as (select *, sum(n) over (order by prob desc) as cn, sum(pos) over (order by prob desc) as cp from v)
    select round(sum(pos * cp / cn) / sum(pos), 6) as average_precision from c""")
def _(fx):
    return E.average_precision(fx["fx_scored"]).select(r6(F.col("average_precision"), "average_precision"))


@query("agg23_brier", "select round(avg(pow(prob - label, 2)), 6) as brier from fx_scored")
def _(fx):
    return fx["fx_scored"].agg(r6(F.avg(F.pow(F.col("prob") - F.col("label"), F.lit(2.0))), "brier"))


@query("agg24_operating_points", f"""with q as (select 0.5 as recall_target, quantile_cont(prob, 0.5) as threshold from fx_scored where label = 1 union all select 0.7, quantile_cont(prob, 0.3) from fx_scored where label = 1 union all select 0.9, quantile_cont(prob, 0.1) from fx_scored where label = 1),
    c as (select recall_target, threshold, {CONF.format(t='threshold')} from q, fx_scored group by recall_target, threshold)
    select recall_target::double as recall_target, round(threshold, 6) as threshold, round({HIT}, 6) as hit_rate, round({FAR}, 6) as far, round({HIT} + {SPEC} - 1, 6) as tss from c""")
def _(fx):
    out = E.operating_points(fx["fx_scored"])
    return out.select("recall_target", *[r6(F.col(c), c) for c in ("threshold", "hit_rate", "far", "tss")])


CONFORMAL = "round(quantile_cont(err, least(1.0, ceil((select count(*) + 1 from fx_scored) * {c}) / (select count(*) from fx_scored))), 6)"


@query("agg25_conformal", """with e as (select abs(label - prob) as err from fx_scored), s as (select err, row_number() over (order by err) - 1 as i, count(*) over () as n from e),
    k as (select name, least(1.0, ceil((n + 1) * c) / n) * (n - 1) as k from (select distinct n from s) z, (values ('q80', 1 - 0.2::double), ('q90', 1 - 0.1::double), ('q95', 1 - 0.05::double)) v(name, c)),
    r as (select name, a.err + (b.err - a.err) * (k - floor(k)) as q from k join s a on a.i = floor(k) join s b on b.i = ceil(k))
    select round(max(q) filter (where name = 'q80'), 6) as q80, round(max(q) filter (where name = 'q90'), 6) as q90, round(max(q) filter (where name = 'q95'), 6) as q95 from r""")
def _(fx):
    return E.conformal_quantiles(fx["fx_scored"]).select(*[r6(F.col(c), c) for c in ("q80", "q90", "q95")])


RELIABLE = """(select p.cell_id, p.prob, e.cell_id is not null as observed from (select cell_id, max(probability) as prob from fx_runs group by cell_id) p left join (select distinct cell_id from fx_truth) e on e.cell_id = p.cell_id)"""


@query("agg26_reliability", f"select b as bin, round(avg(prob), 6) as predicted_mean, round(avg(observed::int), 6) as observed_freq, count(*) as n from (select *, cast(least(9, greatest(0, floor(prob * 10))) as int) as b from {RELIABLE} r) t group by b")
def _(fx):
    seen = fx["fx_truth"].select("cell_id").distinct().withColumn("observed", F.lit(True))
    pred = fx["fx_runs"].groupBy("cell_id").agg(F.max("probability").alias("prob"))
    pairs = pred.join(seen, "cell_id", "left").withColumn("observed", F.coalesce("observed", F.lit(False)))
    out = E.reliability_bins(pairs, min_positives=20)
    return out.select("bin", r6(F.col("predicted_mean"), "predicted_mean"), r6(F.col("observed_freq"), "observed_freq"), "n")


def two_samples(fx: Frames):
    """First and last part of the assessment log as reference and candidate."""
    a = fx["fx_assess"].withColumnRenamed("score", "v")
    day = F.lit("1998-06-01").cast("timestamp_ntz")
    return a.filter(F.col("computed_at") < day), a.filter(F.col("computed_at") >= day)


REF, CAND = "(select score as v, k from fx_assess where computed_at < timestamp '1998-06-01')", "(select score as v, k from fx_assess where computed_at >= timestamp '1998-06-01')"
PSI = f"""s as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from {REF} r),
    e as (select list(v order by j) as e from (select j, (select v from s where i = floor(j / 10.0::double * (n - 1))) as v from range(11) r(j), (select distinct n from s) z) q),
    b as (select src, cast(floor(list_position(list_transform(range(10), lambda j: v >= e[j + 1] and (v < e[j + 2] or (j = 9 and v = e[j + 2]))), true)) as int) as b
          from (select 0 as src, v from {REF} r union all select 1, v from {CAND} c) u, e),
    c as (select src, b, count(*) as n from b where b > 0 group by src, b),
    t as (select src, sum(n) as n from c group by src),
    h as (select j, greatest(1e-6, coalesce((select c.n / t.n from c join t on t.src = c.src where c.src = 0 and c.b = j + 1), 0)) as r,
                    greatest(1e-6, coalesce((select c.n / t.n from c join t on t.src = c.src where c.src = 1 and c.b = j + 1), 0)) as q from range(10) x(j)),
    psi as (select greatest(0, sum((q - r) * (ln(q) - ln(r)))) as psi from h)"""
KS = f"""u as (select v, sum(r) as r, sum(c) as c from (select v, 1 as r, 0 as c from {REF} a union all select v, 0, 1 from {CAND} b) z group by v),
    w as (select sum(r) over (order by v) / (select sum(r) from u) as fr, sum(c) over (order by v) / (select sum(c) from u) as fc from u), ks as (select max(abs(fr - fc)) as ks from w)"""


@query("agg27_stability_index", f"with {PSI} select round(psi, 6) as psi from psi")
def _(fx):
    ref, cand = two_samples(fx)
    return E.population_stability(ref, cand).select(r6(F.col("psi"), "psi"))


@query("agg28_ks_distance", f"with {KS} select round(ks, 6) as ks from ks")
def _(fx):
    ref, cand = two_samples(fx)
    return E.ks_distance(ref, cand).select(r6(F.col("ks"), "ks"))


@query("agg29_prediction_drift", f"select round(abs((select avg(v) from {CAND} c) - (select avg(v) from {REF} r)), 6) as drift")
def _(fx):
    ref, cand = two_samples(fx)
    return ref.agg(F.avg("v").alias("a")).select(r6(F.abs(cand.agg(F.avg("v").alias("b")).scalar() - F.col("a")), "drift"))


@query("agg30_pip10_drift_report", f"""with {PSI}, {KS}, r as (select psi, ks, abs((select avg(k) from {CAND} c) - (select avg(k) from {REF} r)) as pd from psi, ks)
    select round(psi, 6) as psi, round(ks, 6) as ks, round(pd, 6) as pred_drift, case when psi >= 0.25 then 'psi' when ks >= 0.2 then 'ks' when pd >= 0.15 then 'prediction' else 'none' end as reason,
           psi >= 0.25 or ks >= 0.2 or pd >= 0.15 as should_retrain from r""")
def _(fx):
    ref, cand = two_samples(fx)
    out = E.drift_report(ref, cand, "v", "k", "k")
    return out.select(*[r6(F.col(c), c) for c in ("psi", "ks", "pred_drift")], "reason", "should_retrain")


ALERTS = "(select cell_id, computed_at as ts from fx_rated where level in ('High', 'VeryHigh') and computed_at >= timestamp '1998-01-01')"
TRUTH = "(select cell_id, event_time from fx_truth where event_time >= timestamp '1998-01-01')"


@query("agg37_backtest_scores", f"""with a as (select cell_id, min(ts) as t, count(*) as n from {ALERTS} a group by cell_id), e as (select cell_id, min(event_time) as et from {TRUTH} t group by cell_id),
    j as (select (epoch_us(et) - epoch_us(t)) / 3.6e9 as lead, e.cell_id as ec, a.cell_id as ac, n from e full join a on a.cell_id = e.cell_id),
    c as (select count(ec) as events, count(ac) as alerted_cells, cast(sum(n) as bigint) as alerts, count(*) filter (where lead > 0 and lead <= 2400) as hits, coalesce(avg(lead) filter (where lead > 0 and lead <= 2400), 0) as ml from j)
    select events, alerted_cells, alerts, hits, events - hits as misses, alerted_cells - hits as false_alarms, round(hits / events, 6) as hit_rate, round((alerted_cells - hits) / alerted_cells, 6) as far, round(ml, 4) as mean_lead_h,
           hits / events >= 0.7 and (alerted_cells - hits) / alerted_cells <= 0.3 and ml >= 18 as accepted from c""")
def _(fx):
    day = F.lit("1998-01-01").cast("timestamp_ntz")
    alerts = fx["fx_rated"].filter(F.col("level").isin("High", "VeryHigh") & (F.col("computed_at") >= day)).select("cell_id", F.col("computed_at").alias("ts"))
    truth = fx["fx_truth"].filter(F.col("event_time") >= day).select("cell_id", "event_time")
    out = E.backtest_gate(E.backtest_scores(alerts, truth, lead_max_h=2400.0))
    return out.withColumns({"hit_rate": F.round("hit_rate", 6), "far": F.round("far", 6), "mean_lead_h": F.round("mean_lead_h", 4)})


# --- training data ----------------------------------------------------------------------
FACTORS = ("susc_ispra", "iffi_density_500", "slope_deg", "pai_class_norm", "litho_weight")


@query("agg9_normalisation", "select aoi_id, factor, round(min(v), 6) as lo, round(max(v), 6) as hi, count(v) as n from (" + " union all ".join(f"select c.aoi_id, '{f}' as factor, s.{f} as v from fx_static s join fx_cells c on c.cell_id = s.cell_id" for f in FACTORS) + ") t where v is not null group by aoi_id, factor")
def _(fx):
    long = lookup_join(fx["fx_static"], fx["fx_cells"].select("cell_id", "aoi_id"), "cell_id", "inner").unpivot(["aoi_id"], list(FACTORS), "factor", "v")
    return long.filter(F.col("v").isNotNull()).groupBy("aoi_id", "factor").agg(r6(F.min("v"), "lo"), r6(F.max("v"), "hi"), F.count("v").alias("n"))


@query("agg40_class_weights", "select label, round((select count(*) from fx_samples) / (2.0 * count(*)), 6) as weight from fx_samples group by label")
def _(fx):
    return L.class_weights(fx["fx_samples"]).withColumn("weight", F.round("weight", 6))


@query("agg41_collinear_pairs", "select 'n_chars' as kept, 'n_blanks' as dropped, round(corr(n_chars, n_blanks), 6) as r from fx_samples having abs(corr(n_chars, n_blanks)) > 0.9 union all select 'n_chars', 'n_stops', round(corr(n_chars, n_stops), 6) from fx_samples having abs(corr(n_chars, n_stops)) > 0.9")
def _(fx):
    return L.prune_collinear(fx["fx_samples"], ["n_chars", "n_blanks", "n_stops", "toxic", "noise"], 0.9).withColumn("r", F.round("r", 6))


@query("ml1_training_set", """with pos as (select distinct cell_id, event_time from fx_slides where event_time >= timestamp '2024-01-20'), b as (select cell_id, concat_ws('|', cast(floor(lon / 0.5) as bigint), cast(floor(lat / 0.5) as bigint)) as split_block from fx_cells),
    bg as (select *, row_number() over (order by md5(concat('42|', cell_id)), cell_id) as rk from b where cell_id not in (select cell_id from pos))
    select p.cell_id, epoch_us(p.event_time) as us, 1 as label, b.split_block from pos p join b on b.cell_id = p.cell_id
    union all select cell_id, epoch_us(timestamp '2024-01-20' + to_days(cast(('0x' || substr(sha256(cast(cell_id as varchar)), 1, 8))::bigint % 3650 as int))), 0, split_block from bg where rk <= (select count(*) from pos) * 5""")
def _(fx):
    out = L.training_set(fx["fx_slides"], fx["fx_cells"], F.lit("2024-01-20").cast("timestamp_ntz"))
    return out.select("cell_id", B.epoch_us("valuation_time").alias("us"), "label", "split_block")


@query("ml2_feature_vectors", "select s.cell_id, coalesce(susc_ispra, 0) as static__susc_ispra, iffi_density_500 as static__iffi_density_500, slope_deg as static__slope_deg, coalesce(litho_weight, 0) as static__litho_weight, coalesce(pai_class_norm, 0) as static__pai_class_norm, coalesce(v, 0) as insar__velocity_mmy from fx_static s left join (select cell_id, round(max(value), 4) as v from fx_slides group by cell_id) i on i.cell_id = s.cell_id")
def _(fx):
    motion = fx["fx_slides"].groupBy("cell_id").agg(F.struct(F.round(F.max("value"), 4).alias("velocity_mmy")).alias("insar"))
    s = fx["fx_static"]
    nested = s.select("cell_id", F.struct(*FACTORS).alias("static")).join(motion, "cell_id", "left")
    names = ["static.susc_ispra", "static.iffi_density_500", "static.slope_deg", "static.litho_weight", "static.pai_class_norm", "insar.velocity_mmy"]
    return nested.select("cell_id", *L.feature_row(nested, names))


@query("ml4_folds", "select split_block, cast((row_number() over (order by md5(concat('42|', split_block)), split_block) - 1) % 5 as int) as fold from (select distinct split_block from fx_samples) t")
def _(fx):
    return L.folds(fx["fx_samples"])


@query("ml8_baselines", f"select id, round(0.35 * 0 + greatest(0, least(1, {BLEND})), 6) as full_model, round(greatest(0, least(1, {EXCESS})), 6) as rain_only from fx_bundle where not (velocity_mmd is not null or acceleration_mmd2 is not null or inverse_velocity is not null)")
def _(fx):
    still = bundle(fx).filter(F.coalesce("velocity_mmd", "acceleration_mmd2", "inverse_velocity").isNull())
    full = S.score(still).select("id", "caine_excess", r6(F.col("score"), "full_model"))
    return full.select("id", "full_model", r6(B.clamp01("caine_excess"), "rain_only"))


@query("ml9_promotion_gate", f"""with c as (select {CONF.format(t=0.5)}, avg(pow(prob - label, 2)) as brier from fx_scored), v as (select prob, count(*) as n, sum(label) as pos from fx_scored group by prob),
    a as (select sum(pos * cp / cn) / sum(pos) as ap from (select *, sum(n) over (order by prob desc) as cn, sum(pos) over (order by prob desc) as cp from v) w)
    select round(ap, 6) as average_precision, round(brier, 6) as brier, round({HIT}, 6) as hit_rate, ap >= 0.55 and brier <= 0.20 and {HIT} >= 0.70 and {FAR} <= 0.30 and 24.0 >= 18 and ap > 0.28 as promoted from c, a""")
def _(fx):
    scored = fx["fx_scored"]
    m = E.skill_at(scored, 0.5).withColumns(
        {
            "average_precision": E.average_precision(scored).scalar(),
            "brier": scored.agg(F.avg(F.pow(F.col("prob") - F.col("label"), F.lit(2.0))).alias("b")).scalar(),
            "mean_lead_h": F.lit(24.0), "baseline_ap": F.lit(0.28),
        }
    )
    return E.promotion_gate(m).select(r6(F.col("average_precision"), "average_precision"), r6(F.col("brier"), "brier"), r6(F.col("hit_rate"), "hit_rate"), "promoted")


@query("ml10_shadow_rows", """select id, cell_id, round(p, 6) as probability, case when p < 0.15 then 'None' when p < 0.35 then 'Low' when p < 0.55 then 'Moderate' when p < 0.75 then 'High' else 'VeryHigh' end as risk_class, 'challenger' as role
    from (select id, cell_id, greatest(0, least(1, """ + EXCESS + """)) as p from fx_bundle) t""")
def _(fx):
    b = bundle(fx).withColumn("aoi_id", F.lit("all"))
    challenger = lambda df: S.rain_only_score(df)
    rows = L.shadow_rows(b.withColumnsRenamed({"cell_id": "place"}).withColumn("cell_id", F.col("id")), challenger, F.lit("2024-01-01").cast("timestamp"), "model://rain", "r1")
    places = b.select(F.col("id").alias("cell_id"), F.col("cell_id").alias("place"))
    return rows.join(places, "cell_id").select(F.col("cell_id").alias("id"), F.col("place").alias("cell_id"), r6(F.col("probability"), "probability"), "risk_class", "role")


@query("ml11_feature_parity", "select cell_id, " + ", ".join(f"cast(coalesce({f}, 0) as double) as {f}" for f in FACTORS) + ", true as same from fx_static")
def _(fx):
    s = fx["fx_static"]
    names = [f"static.{f}" for f in FACTORS]
    nested = s.select("cell_id", F.struct(*FACTORS).alias("static"))
    train = nested.select("cell_id", F.struct(*L.feature_row(nested, names)).alias("a"))
    flat = s.select("cell_id", *[F.col(f).alias(f"static__{f}") for f in FACTORS])
    serve = flat.select("cell_id", F.struct(*L.feature_row(flat, names)).alias("b"))
    values = [F.col(f"b.static__{f}").cast("double").alias(f) for f in FACTORS]
    return train.join(serve, "cell_id").select("cell_id", *values, (F.col("a") == F.col("b")).alias("same"))


@query("fn25_flat_features", "select cell_id, coalesce(susc_ispra, 0) as static__susc_ispra, 0::double as static__twi, coalesce(litho_weight, 0) as static__litho_weight from fx_static")
def _(fx):
    nested = fx["fx_static"].select("cell_id", F.struct("susc_ispra", "litho_weight").alias("static"))
    return nested.select("cell_id", *L.feature_row(nested, ["static.susc_ispra", "static.twi", "static.litho_weight"]))


@query("sco17_attribution", """with m as (select id, greatest(0, least(1, score)) as p, abs(coalesce(slope_deg, 0)) + abs(coalesce(iffi_density_500, 0)) + abs(rain_24h_mm) as s, abs(coalesce(api_30_mm, 0)) as m, abs(pga_g) as e from (select *, event_hours / 80 as score from fx_bundle) b)
    select id, round(s * p / (s + m + e), 6) as s, round(m * p / (s + m + e), 6) as m, round(e * p / (s + m + e), 6) as e from m""")
def _(fx):
    names = ["static.slope_deg", "static.iffi_density_500", "rain.rain_24h_mm", "api.api_30_mm", "seismic.pga_g"]
    b = fx["fx_bundle"].withColumn("prob", F.col("event_hours") / 80)
    flat = b.select("id", "prob", *[F.col(n.split(".")[1]).alias(L.column_name(n)) for n in names])
    return L.attribution(flat, names, key="id").select("id", *[r6(F.col(c), c) for c in "sme"])


# --- fitted models: no SQL form --------------------------------------------------------------
FIT_FEATURES = ["doc.n_chars", "doc.n_blanks", "doc.n_stops", "doc.toxic", "doc.noise"]


def training_frame(fx: Frames):
    flat = fx["fx_samples"].select(
        "cell_id", "split_block", "label", *[F.col(n.split(".")[1]).alias(L.column_name(n)) for n in FIT_FEATURES]
    )
    return L.assemble(flat, FIT_FEATURES)


@query("ml5_out_of_fold")
def _(fx):
    return L.out_of_fold(training_frame(fx), 3, max_iter=5, max_depth=3).select("cell_id", "label", "fold", r6(F.col("prob"), "prob"))


@query("ml6_search")
def _(fx):
    grid = [{"max_iter": 3, "max_depth": 2}, {"max_iter": 3, "max_depth": 4}]
    return L.search(training_frame(fx), grid, 2)


@query("ml7_isotonic")
def _(fx):
    return L.isotonic(fx["fx_scored"]).select("cell_id", "label", "prob", r6(F.col("calibrated"), "calibrated"))


@query("agg24_percentiles_by_block", "select split_block, round(quantile_cont(prob, 0.25), 6) as p25, round(quantile_cont(prob, 0.9), 6) as p90 from fx_scored group by split_block")
def _(fx):
    out = exact_percentiles(fx["fx_scored"], "prob", {"p25": 0.25, "p90": 0.9}, ["split_block"])
    return out.select("split_block", r6(F.col("p25"), "p25"), r6(F.col("p90"), "p90"))
