"""Late observations in the stream: whatever the batches, the hours are those of all rows at once."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from slopewatch.operators.sensors import hourly_features
from slopewatch.streaming.late import HourStore, hourly_partials, merged_hours

START = datetime(2024, 3, 1)
PROPERTIES = ("rainfall", "pore_pressure", "soil_moisture", "displacement", "velocity")
SCHEMA = "id long, device_id string, observed_property string, phenomenon_time timestamp, result_value double, quality string"


def observation(rnd, i, hour):
    time = START + timedelta(hours=hour, seconds=rnd.choice([0, 0, 5, 1800, 3599]))
    return (i, f"d{rnd.randrange(3)}", rnd.choice(PROPERTIES), time, round(rnd.uniform(0, 50), 3), rnd.choice(["ok", "ok", "ok", "gap", None]))


def told(features):
    number = lambda v: None if v is None else round(v, 6)
    cols = ("rainfall_mm", "pore_pressure_kpa", "soil_moisture", "displacement_mm", "velocity_mmd")
    return sorted((r["device_id"], r["bucket"], *[(-1 if number(r[c]) is None else number(r[c])) for c in cols], r["sample_count"], r["last_observation_at"]) for r in features.collect())


def whole(spark, rows):
    return told(hourly_features(spark.createDataFrame(rows, SCHEMA), F.date_trunc("hour", "phenomenon_time")))


def test_batches_five_hours_late_give_the_rows_of_one(spark, tmp_path):
    rnd = random.Random(1)
    first = [observation(rnd, i, rnd.randrange(20, 30)) for i in range(150)]
    late = [observation(rnd, 1000 + i, rnd.randrange(18, 25)) for i in range(80)]  # 5 hours and more behind the first
    newer = [observation(rnd, 2000 + i, rnd.randrange(28, 34)) for i in range(60)]
    store = HourStore(spark, str(tmp_path / "a"))
    for n, rows in enumerate((first, late, newer, late[:0])):
        store.take(spark.createDataFrame(rows, SCHEMA), n)
    assert told(store.hours()) == whole(spark, first + late + newer)
    for n, rows in ((1, late), (2, newer)):  # a batch that is taken again
        store.take(spark.createDataFrame(rows, SCHEMA), n)
    assert told(store.hours()) == whole(spark, first + late + newer)
    repairs = spark.read.parquet(str(tmp_path / "a" / "repairs"))
    closed = START + timedelta(hours=29 - 3)
    assert repairs.filter("batch_id = 1").count() > 0 and repairs.filter(F.col("bucket") > closed).count() == 0


def test_stream_of_files(spark, tmp_path):
    rnd = random.Random(2)
    batches = [[observation(rnd, 100 * b + i, rnd.randrange(0, 60)) for i in range(60)] for b in range(3)]
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{b}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    store = HourStore(spark, str(tmp_path / "store")).run(stream)
    assert told(store.hours()) == whole(spark, sum(batches, []))
    assert spark.read.parquet(str(tmp_path / "store" / "marks")).count() == 3
    rain = {}
    for b in batches:
        for _, device, prop, time, value, quality in b:
            for i in range(1, 4):
                if prop == "rainfall" and quality == "ok":
                    key = (device, time.replace(minute=0, second=0) + timedelta(hours=i))
                    rain[key] = (rain.get(key, (0, 0))[0] + value, rain.get(key, (0, 0))[1] + 1)
    got = {(r["device_id"], r["as_of"]): (round(r["mm"], 6), r["n"]) for r in store.rain_windows(3).collect()}
    assert got == {k: (round(mm, 6), n) for k, (mm, n) in rain.items()}
    # nothing new: nothing changes
    assert told(store.run(stream).hours()) == whole(spark, sum(batches, []))


def test_partials_merge_in_any_cut(spark):
    rnd = random.Random(3)
    rows = [observation(rnd, i, rnd.randrange(0, 4)) for i in range(200)]
    close = [(900 + i, "d9", "displacement", START + timedelta(hours=1, minutes=55, microseconds=i), 100.0 + 2 * i, "ok") for i in range(4)]
    hour = F.date_trunc("hour", "phenomenon_time")
    cut = [spark.createDataFrame([r for r in rows + close if r[0] % 3 == k], SCHEMA) for k in range(3)]
    parts = hourly_partials(cut[0], hour).unionByName(hourly_partials(cut[1], hour)).unionByName(hourly_partials(cut[2], hour))
    got, want = told(merged_hours(parts)), whole(spark, rows + close)
    slope = lambda out: [r[6] for r in out if r[0] == "d9"][0]
    assert [r for r in got if r[0] != "d9"] == [r for r in want if r[0] != "d9"]
    assert abs(slope(got) / slope(want) - 1) < 1e-6  # microseconds apart: moments are centred


def test_nothing_but_unused_rows(spark, tmp_path):
    store = HourStore(spark, str(tmp_path))
    store.take(spark.createDataFrame([], SCHEMA), 0)
    store.take(spark.createDataFrame([(1, "d", "velocity", START, 1.0, "ok"), (2, None, "rainfall", START, 1.0, "ok"), (3, "d", "rainfall", None, 1.0, "ok")], SCHEMA), 1)
    assert [(r["device_id"], r["sample_count"]) for r in store.hours().filter("bucket is not null").collect()] == [(None, 1)]
