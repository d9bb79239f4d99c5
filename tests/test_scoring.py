"""Known answers and properties of the scoring model."""

import math

import pytest
from pyspark.sql import functions as F

from slopewatch.functions import basic as B
from slopewatch.functions import geo as G
from slopewatch.functions import scoring as S
from slopewatch.functions import text as TX
from slopewatch.params import PARAMS, ParameterError, check, merged


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_parameters_are_consistent_and_bad_ones_refused():
    check(merged())
    with pytest.raises(ParameterError):
        merged({"component_weights": {"s": 0.9}})
    with pytest.raises(ParameterError):
        merged({"class_bounds": [0.5, 0.3, 0.6, 0.7]})
    with pytest.raises(ParameterError):
        merged({"exposure": {"road_strong_m": 5000.0}})


def test_class_bounds_are_inclusive_below(spark):
    row = one(spark, *[B.level_of(F.lit(x)) for x in (0.0, 0.15, 0.35, 0.55, 0.75, 1.0)])
    assert list(row) == ["None", "Low", "Moderate", "High", "VeryHigh", "VeryHigh"]


def test_clamp_treats_nan_and_null_as_zero(spark):
    row = one(spark, *[B.clamp01(F.lit(x).cast("double")) for x in (float("nan"), None, -1.0, 2.0, 0.4)])
    assert list(row) == [0.0, 0.0, 0.0, 1.0, 0.4]


def test_threshold_and_excess(spark):
    r = one(spark, S.threshold_intensity(F.lit(10.0), F.lit("italy_default")), S.rain_excess(F.lit(100.0), F.lit(10.0), F.lit("nowhere")),
            S.rain_excess(F.lit(None).cast("double"), F.lit(10.0), F.lit("italy_default")))
    law = 7.190 * 10 ** -0.568
    assert r[0] == pytest.approx(law)
    assert r[1] == pytest.approx(math.log10(10.0 / law))
    assert r[2] == 0.0
    with pytest.raises(Exception, match="positive"):
        one(spark, S.threshold_intensity(F.lit(0.0), F.lit("italy_default")))


def test_neutral_values_without_inputs(spark):
    r = one(spark, S.wetness(F.lit(None).cast("double")), S.soil_wetness(F.lit(None).cast("double")), S.fire_component(F.lit(None).cast("double")),
            S.seismic_component(F.lit(0.0)), S.fire_component(F.lit(6.0)))
    assert list(r) == [0.5, 0.5, 0.0, 0.0, 1.0]


def test_seismic_decay_drops_small_old_and_future(spark):
    pga = lambda m, age: S.decayed_pga(F.lit(0.2), F.lit(m), F.lit(age))
    r = one(spark, pga(5.0, 2.0), pga(3.0, 1.0), pga(5.0, 8.0), pga(5.0, -0.1))
    assert r[0] == pytest.approx(0.2 * math.exp(-1)) and list(r)[1:] == [0.0, 0.0, 0.0]


def test_flood_signal_of_zero_is_absent(spark):
    up = lambda rain, ratio, surge, hz: S.flood_uplift(F.lit(rain).cast("double"), F.lit(ratio).cast("double"), F.lit(surge).cast("double"), F.lit(hz).cast("double"), F.lit("italy_default"))
    r = one(spark, up(0.0, 0.0, None, 1.0), up(None, None, 0.6, 1.0), up(500.0, None, None, None), up(90.0, None, None, 0.8))
    assert list(r) == pytest.approx([0.0, 0.3, 0.0, 0.2])


def test_kinematic_alarm_forces_floor_and_escalation(spark):
    k = lambda v, a, i: S.kinematic_terms(F.lit(v).cast("double"), F.lit(a).cast("double"), F.lit(i).cast("double"))
    alarm, inverse, none, fast, slow = one(spark, k(0.1, 2.0, None), k(None, None, 0.1), k(None, None, None), k(9.0, None, None), k(2.0, None, None))
    assert alarm.hard_escalation and alarm.k >= 0.8 and inverse.hard_escalation and inverse.k == 0.8
    assert not none.active and none.k == 0.0 and fast.k > slow.k


def test_exposure_bands_fallback_and_cap(spark):
    ex = lambda uh, un, ih, inr, road, rail: S.exposure_terms(*[F.lit(x) for x in (uh, un, ih, inr)], F.lit(road).cast("double"), F.lit(rail).cast("double"), F.lit("motorway"))
    cap, graded, cover, near = one(spark, ex(True, False, False, False, 100.0, 100.0), ex(False, False, True, False, 800.0, None), ex(False, False, True, False, 9000.0, None), ex(False, True, False, True, None, None))
    assert cap.factor == 2.0 and cap.tags == ["abitato", "autostrada a 100 m", "ferrovia a 100 m"]
    assert graded.factor == pytest.approx(0.3) and cover.tags == ["infrastrutture"] and cover.factor == pytest.approx(0.6)
    assert near.factor == pytest.approx(0.8)


def bundles(spark):
    rows = [(i, 0.1 * (i % 10), float(i % 50), float(i % 9), float(i % 40), 0.01 * (i % 60)) for i in range(200)]
    return spark.createDataFrame(rows, "cell_id int, pai_class_norm double, slope_deg double, iffi_density_500 double, rain double, soil_moisture double").withColumns(
        {"event_hours": F.lit(6.0), "macroregion": F.lit("italy_default")}
    )


def test_score_range_and_monotone_in_rain(spark):
    b = bundles(spark)
    dry = S.score(b.withColumn("caine_excess", S.rain_excess(F.col("rain"), F.col("event_hours")))).select("cell_id", F.col("score").alias("a"))
    wet = S.score(b.withColumn("caine_excess", S.rain_excess(F.col("rain") + 50, F.col("event_hours")))).select("cell_id", F.col("score").alias("b"))
    j = dry.join(wet, "cell_id").agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.count_if(F.col("b") < F.col("a")).alias("worse")).first()
    assert 0 <= j.lo and j.hi <= 1 and j.worse == 0


def test_no_sensors_no_snow_no_flood_feed_change_nothing(spark):
    b = bundles(spark).withColumn("caine_excess", F.lit(0.2))
    plain = S.score(b)
    nulls = S.score(b.withColumns({c: F.lit(None).cast("double") for c in ("velocity_mmd", "snow_depth_m", "flood_rain_72h_mm", "sensor_rainfall_mm")}))
    assert plain.select("cell_id", "score", "level").exceptAll(nulls.select("cell_id", "score", "level")).count() == 0
    assert plain.filter("monitored or hard_escalation").count() == 0


def test_measured_values_replace_and_are_listed(spark):
    b = bundles(spark).limit(1).withColumns({"caine_excess": F.lit(0.0), "sensor_rainfall_mm": F.lit(1.0), "sensor_pore_kpa": F.lit(30.0)})
    m = S.score(b).select("breakdown.meteo_terms.*").first()
    assert (m.caine, m.api, list(m.measured)) == (0.5, 0.5, ["caine", "api"])


def test_metric_grid_reference_point_and_round_trip(spark):
    x, y = G.to_3035(F.lit(5.0), F.lit(50.0))
    r = one(spark, x, y)
    assert r[0] == pytest.approx(3962799.45, abs=0.01) and r[1] == pytest.approx(2999718.85, abs=0.01)
    lon, lat = G.from_3035(x, y)
    back = one(spark, lon, lat)
    assert back[0] == pytest.approx(5.0, abs=1e-8) and back[1] == pytest.approx(50.0, abs=1e-8)


def test_haversine_and_shoelace(spark):
    r = one(spark, G.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), G.shoelace(F.array(*[F.lit(v) for v in (0.0, 2.0, 2.0, 0.0)]), F.array(*[F.lit(v) for v in (0.0, 0.0, 3.0, 3.0)])))
    assert r[0] == pytest.approx(math.radians(1) * 6371008.8) and r[1] == 6.0


def test_lithology_first_match_wins(spark):
    r = one(spark, *[S.lithology_weight(F.lit(t)) for t in ("Argille  marnose", "marne", "Complesso   Caotico", "altro")])
    assert list(r) == [0.85, 0.70, 0.85, 0.5]


def test_region_names_and_distance_words(spark):
    r = one(spark, TX.region_token(F.lit("IT-Emilia-Romagna")), TX.region_title(F.lit("it-valle-d-aosta")), S.distance_text(F.lit(99.9)), S.distance_text(F.lit(145.0)), S.distance_text(F.lit(1234.0)))
    assert list(r) == ["emilia_romagna", "Valle D Aosta", "meno di 100 m", "140 m", "1,2 km"]


def test_briefing_rules(spark):
    good = " ".join(["parola"] * 160)
    allowed = TX.allowed_numbers(F.lit('{"score":0.734,"n":12,"t":"2021"}'))
    texts = [good, "corto", good + "\n- punto", good + " settantadue", good + " emergenza", good + " 0,73 12 24", good + " 99"]
    rows = [one(spark, TX.briefing_check(F.lit(t), allowed))[0] for t in texts]
    assert [list(r.violations) for r in rows] == [[], ["length"], ["bullets"], ["spelled_numbers"], ["banned:emergenza"], [], ["unknown_numbers"]]
    assert rows[-1].unknown == ["99"]


def test_alert_colours_cover_all_levels(spark):
    assert set(PARAMS["alert_colour"]) == {"None", "Low", "Moderate", "High", "VeryHigh"}
