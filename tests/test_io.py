"""Readers on landed files, writers, and streams over several micro-batches."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slopewatch.operators import sensors as N
from slopewatch.sinks import tables as K
from slopewatch.sources import features as SF
from slopewatch.sources import weather as SW
from slopewatch.streaming import alerts as A
from slopewatch.streaming import ingest as I

T0 = datetime(2024, 1, 1)


def test_event_catalogue_with_byte_order_mark(spark, tmp_path):
    lines = ["id;lon;lat;utc_date;information_source;region", "e1;16.88;41.14;05/03/2020 10:30;press;Puglia", "e2;16.9;41.2;06/03/2020;;", ";16;41;06/03/2020;;", "e4;x;41;06/03/2020;;", "e5;16;41;2020-01-01;;"]
    (tmp_path / "c.csv").write_text("﻿" + "\n".join(lines), encoding="utf-8")
    good, bad = SF.read_event_catalogue(spark, str(tmp_path / "c.csv"))
    assert [(r.id, r.source, r.event_time) for r in good.orderBy("id").collect()] == [("e1", "press", datetime(2020, 3, 5, 10, 30)), ("e2", "unknown", datetime(2020, 3, 6))]
    assert bad.count() == 3


def test_feature_collection_and_seed(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": "it-puglia", "name": "Puglia", "kind": "region", "pop": 4}, "geometry": {"type": "Point", "coordinates": [16, 41]}}]}
    (tmp_path / "r.geojson").write_text(json.dumps(fc, indent=1))
    row = SF.region_seed(SF.collection_features(spark, str(tmp_path / "r.geojson"))).first()
    assert (row.aoi_id, row["name"], row.kind, row.metadata) == ("it-puglia", "Puglia", "region", {"pop": "4"})


def test_corpus_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.paper.md").write_text("\n## Titolo\ntesto")
    (tmp_path / "b.pai.md").write_text("   \n")
    (tmp_path / "c.other").write_text("x")
    rows = SF.documents(spark, str(tmp_path)).collect()
    assert [(r.kind, r.title) for r in rows] == [("paper", "Titolo")]


def test_hazard_class_and_token(spark):
    r = spark.range(1).select(*[SF.hazard_class(F.lit(t)) for t in (" p3 ", "Pn.d.", None)], *[SF.hazard_token(F.lit(t)) for t in ("Elevata p3", "none", "AREE AA")]).first()
    assert list(r) == ["P3", "UNKNOWN", "UNKNOWN", "P3", None, "AA"]


def test_weather_payloads(spark):
    p = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "precipitation": [None, 2.0]}, "daily": {"river_discharge": [1.0, 1.0] + [2.0] * 6 + [4.0]}}
    df = spark.createDataFrame([(1, json.dumps(p)), (2, json.dumps([p, p])), (3, None)], "id int, payload string")
    s = SW.hourly_samples(df.filter("id = 1")).orderBy("ts").collect()
    assert [(r.ts, r.precipitation_mm) for r in s] == [(T0, 0.0), (T0 + timedelta(hours=1), 2.0)]
    n = SW.node_series(df).groupBy("id").agg(F.count("mm").alias("n"), F.max("node_pos").alias("p")).orderBy("id").collect()
    assert [(r.n, r.p) for r in n] == [(2, 0), (4, 1), (0, None)]
    assert SW.flood_signals(df.filter("id = 1")).first().discharge_ratio == pytest.approx(4.0)


def test_partition_writes_and_dynamic_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("road", 1), ("rail", 2)], "kind string, id int")
    K.overwrite_partitions(df, path, ["kind"])
    K.overwrite_partitions(spark.createDataFrame([("rail", 9)], "kind string, id int"), path, ["kind"])
    assert {(r.kind, r.id) for r in K.read_table(spark, path).collect()} == {("road", 1), ("rail", 9)}


def test_reverted_source_is_loaded_again(spark):
    reg = spark.createDataFrame([("d", "A", T0), ("d", "B", T0 + timedelta(days=1))], "dataset string, version string, fetched_at timestamp")
    now = spark.createDataFrame([("d", "A")], "dataset string, version string")
    assert K.register_version(reg, now, F.lit(T0 + timedelta(days=2))).count() == 3
    same = spark.createDataFrame([("d", "B")], "dataset string, version string")
    assert K.register_version(reg, same, F.lit(T0 + timedelta(days=2))).count() == 2


def test_contract_rejects(spark):
    def msg(topic="hazard/v1/r/s/d1/ds/obs", **over):
        body = {"thing_id": "d1", "observed_property": "rainfall", "phenomenon_time": "2024-01-01T00:00:00Z", "result_value": 1.0, "result_unit": "mm", **over}
        return topic, json.dumps({k: v for k, v in body.items() if v is not None})

    cases = {
        None: msg(), "bad_topic": msg("hazard/v1/d1/obs"), "thing_mismatch": msg("hazard/v1/r/s/d2/ds/obs"),
        "bad_payload": msg(phenomenon_time="2024-01-01T00:00:00"),
    }
    bad = [msg(extra=1), msg(result_value="7"), msg(observed_property="x"), msg(result_unit=""), msg(contract_version="2"), ("hazard/v1/r/s/d1/ds/obs", "{oops")]
    df = spark.createDataFrame([(str(k), *v) for k, v in cases.items()] + [("bad_payload", *b) for b in bad], "want string, topic string, payload string")
    assert I.parse(df).filter(~F.col("want").eqNullSafe(F.coalesce("reject", F.lit("None")))).count() == 0


def spread(spark, df, path, parts):
    for i in range(parts):
        df.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)


def test_quality_state_over_batches_equals_batch(spark, tmp_path):
    rows = [(i, f"d{i % 3}", "rainfall", T0 + timedelta(minutes=7 * i + (200 if i > 150 else 0)), [1.0, 1.0, 300.0, 9.0][(i // 20) % 4], i // 60) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, device_id string, observed_property string, phenomenon_time timestamp, result_value double, part int")
    spread(spark, df, str(tmp_path / "in"), 4)
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = I.drain(I.stream_quality(stream), "q")
    assert got.select("batch_id").distinct().count() >= 4
    want = N.quality(df.drop("part")).select("id", "quality")
    assert got.select("id", "quality").exceptAll(want).count() == 0 and got.count() == 240
    assert {r.quality for r in want.distinct().collect()} >= {"ok", "gap", "spike", "range", "flatline"}


def test_suppression_over_batches_equals_batch(spark, tmp_path):
    rows = [(i, f"c{i % 2}", T0 + timedelta(minutes=47 * i), i // 30) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, cell_id string, ts timestamp, part int")
    spread(spark, df, str(tmp_path / "in"), 3)
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = I.drain(A.suppress_stream(stream, "cell_id", 180), "s").select("cell_id", "ts")
    want = A.suppress_batch(df, "cell_id", 180).select("cell_id", "ts")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 10
