"""Mixing to target weights against a plain loop, and the copies taken."""

from __future__ import annotations

import pytest

from slopewatch.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long"


def looped(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Share by weight, stop at three times, share the excess anew until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = sum(sizes.values()) - sum(target.values())
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: 3.0 * sizes[s] for s in above}
        open_ -= above
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 500, "c": 400, "d": 2, None: 90}, {None: 7}, {"a": 0, "b": 5}])
def test_targets(spark, sizes):
    rows = [(i, " ".join(["w"] * n), s, 0) for i, (s, n) in enumerate(sizes.items())]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, SCHEMA).select("source", mixing.size_of(mixing.F.col("text")).alias("size"))).collect()}
    want = looped(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), ("a", "b", "c", None)[i % 4], 1) for i in range(4000)] + [(None, "x y", "a", 1), (None, "x y", "a", 1), (5001, None, "b", 1), (5002, "", "z", 1)]
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    total: dict = {}
    for r in got:
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["taken"] <= 3 * r["size"]
        total[r["source"]] = total.get(r["source"], 0) + r["taken"]
        if r["source"] == "z":
            assert r["target"] == 0 and r["taken"] == 0
    for r in got:
        assert abs(total[r["source"]] - r["target"]) <= max(0.01 * r["target"], 40)
    again = mixing.mixed(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["taken"])
    assert sorted(map(key, got), key=str) == sorted(map(key, again), key=str)


def test_emitted_and_empty(spark):
    rows = [(1, "a b", "s", 3), (2, "c", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", mixing.F.lit("own"))
    out = mixing.emitted(docs.drop("size"))
    assert out.columns == ["doc_id", "text", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]  # one source: rate 1
    assert mixing.mixed(docs.limit(0)).count() == 0
