"""Memory of one Python process that works on a full Arrow batch."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from slopewatch.llm import lines, neardup, quality, texts
from slopewatch.llm.texts import slices

WORDS = np.random.default_rng(1).integers(100, 20_000, (4000, 180))
BATCH = pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": ["\n".join(" ".join(f"w{x}" for x in part) for part in np.split(row, 6)) for row in WORDS]})


class Frame:
    """Stands for a table: keeps the function that Spark would run on its batches."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda w: SimpleNamespace(value=w)))

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


@pytest.mark.parametrize("step", [lambda d: quality.scored(d, np.zeros((1 << quality.BITS) + 1)), lines.numbered, lambda d: neardup.signatures(d, 5)], ids=["quality", "lines", "neardup"])
def test_a_batch_takes_little(step, monkeypatch):
    monkeypatch.setattr(texts, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    run, size = step(Frame()).run, BATCH.column("text").nbytes
    assert 3 << 20 < size < 6 << 20
    tracemalloc.start()
    try:
        rows = sum(len(x) for x in run(iter([BATCH])))
        peak, kept = tracemalloc.get_traced_memory()[1], sum(p.nbytes for p in texts._POWERS)
    finally:
        tracemalloc.stop()
    assert rows >= len(BATCH) and kept < 12 << 20
    assert peak < 64 << 20, peak >> 20


def test_slices_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"text": ["ab", None, "", "abcdefgh", "abc", "a", "b"]})
    got = [part.column("text").to_pylist() for part in slices(batch, most=4)]
    assert [x for part in got for x in part] == batch.column("text").to_pylist()
    assert all(len(part) == 1 or sum(len(x or "") for x in part) <= 4 for part in got)
