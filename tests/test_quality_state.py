"""The quality state: chunks equal one batch, and idle devices are forgotten."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from slopewatch.params import PARAMS
from slopewatch.streaming import ingest as I

START = datetime(2024, 1, 1)
SCHEMA = "id long, device_id string, observed_property string, phenomenon_time timestamp, result_value double"


class Value:
    """Stands in for a state variable."""

    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def labelled(frames, chunk_rows):
    state = I.QualityState(PARAMS["sensor"], chunk_rows=chunk_rows)
    state.history, out = Value(), []
    for batch in frames:
        out += list(state.handleInputRows(("d", "rainfall"), iter(batch), None))
    got = pd.concat(out)
    return dict(zip(got["id"], got["quality"], strict=True)), state.history.value


def test_chunks_equal_one_batch():
    rnd = np.random.default_rng(1)
    n = 400
    rows = pd.DataFrame({
        "id": np.arange(n), "device_id": "d", "observed_property": "rainfall", "phenomenon_time": [pd.Timestamp(START) + pd.Timedelta(minutes=int(m)) for m in np.sort(rnd.integers(0, 9000, n))],
        "result_value": np.where(np.arange(n) % 50 < 20, 3.0, rnd.integers(0, 60, n)).astype(float),
    })
    shuffled = rows.sample(frac=1, random_state=3)
    one = labelled([[rows]], 10_000)
    assert set(one[0].values()) >= {"ok", "flatline", "gap"}
    for chunk in (1, 7, 13, 399):
        assert labelled([[shuffled.iloc[:150], shuffled.iloc[150:]]], chunk) == one
    halves = [[rows.iloc[:201]], [rows.iloc[201:]]]
    assert labelled(halves, 5) == one


def test_an_idle_device_is_forgotten(spark, tmp_path):
    """Twelve equal values in a row are a flat line, unless the series was silent beyond the ttl in between."""
    rnd = random.Random(1)
    flat = lambda device, first, hour, k: [(first + i, device, "rainfall", START + timedelta(hours=hour, minutes=i), 3.0) for i in range(k)]
    busy = lambda first, hour: [(first, "busy", "rainfall", START + timedelta(hours=hour), float(rnd.randrange(9)))]
    batches = [flat("idle", 0, 0, 11) + busy(100, 0), busy(101, 30), busy(102, 60), flat("idle", 200, 61, 1) + busy(103, 61)]
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{b}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    kept = {r["id"]: r["quality"] for r in I.drain(I.stream_quality(stream), "kept").collect()}
    gone = {r["id"]: r["quality"] for r in I.drain(I.stream_quality(stream, ttl_hours=24.0), "gone").collect()}
    assert kept[200] == "flatline" and gone[200] == "ok"  # as for a device never seen
    assert {k: v for k, v in kept.items() if k != 200} == {k: v for k, v in gone.items() if k != 200}
