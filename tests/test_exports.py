"""Zone collections in parts, and merges that touch only their buckets."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from slopewatch.operators import relational as R
from slopewatch.sinks import tables as K
from slopewatch.sinks.bucketed import BucketedTable


def test_zone_texts_make_up_a_collection(spark, tmp_path):
    rnd = random.Random(1)
    rows = [("hot" if k % 3 else f"z{k % 5}", f"c{k:04d}", "High<", round(rnd.choice([0.6, 0.61, rnd.random()]), 4), 10 + k / 100, 45.0) for k in range(300)]
    members = spark.createDataFrame(rows, "zone string, cell_id string, level string, score double, lon double, lat double").repartition(7)
    texts = K.zone_collections(members, per_text=40).collect()
    for zone in {r[0] for r in rows}:
        parts = sorted((r["part"], r["parts"], r["text"]) for r in texts if r["zone"] == zone)
        assert [p for p, _, _ in parts] == list(range(parts[0][1]))
        text = "".join(t for _, _, t in parts)
        assert "<" not in text
        got = [(f["properties"]["cell_id"], f["properties"]["level"]) for f in json.loads(text)["features"]]
        assert got == [(c, lv) for _, c, lv, _ in sorted((-s, c, lv, 0) for z, c, lv, s, _, _ in rows if z == zone)]
        assert max(t.count('"Feature"') for _, _, t in parts) <= 40
    K.write_zone_collections(members, str(tmp_path / "zones"), per_text=40)
    names = sorted((tmp_path / "zones" / "zone=hot").glob("part=*/part-*.txt"))
    assert len(names) == 5 and len(json.loads("".join(n.read_text() for n in names))["features"]) == 200
    assert K.zone_collections(members.limit(0)).count() == 0


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (path / "data").rglob("*.parquet")}


def named(table, version=None):
    """Rows by key, and the files each bucket lies in."""
    return {r["id"]: (r["n"], r["seen"]) for r in table.read(version).collect()}, table.current(version)[1]


def test_a_merge_of_one_key_leaves_other_files_alone(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, n long, seen string").schema
    table = BucketedTable(spark, str(tmp_path), schema, ["id"], buckets=8)
    assert table.read().count() == 0
    add = lambda old, new: R.merge_accumulating(old, new, ["id"], ["n"], ["seen"])
    start = spark.range(200).select("id", F.lit(1).cast("bigint").alias("n"), F.lit("a").alias("seen"))
    assert table.merge(start, add, "first") == 1
    before, folders = named(table)
    kept = files(tmp_path)
    one = spark.createDataFrame([(17, 5, "b")], schema)
    assert table.merge(one, add, "second") == 2
    after, moved = named(table)
    assert after == {**before, 17: (6, "b")}
    assert sum(folders[b] != moved[b] for b in folders) == 1  # one bucket was swapped
    now = files(tmp_path)
    assert all(now[f] == t for f, t in kept.items())
    assert table.merge(one, add, "second") == 2 and named(table)[0] == after  # a merge that is done
    assert named(table, 1)[0] == before  # the version before is still there
    assert {r["id"]: r["n"] for r in table.lookup(spark.createDataFrame([(17,), (3,), (900,)], "id long")).collect()} == {17: 6, 3: 1}


def test_rules_give_what_whole_tables_give(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, n long, seen string").schema
    rnd = random.Random(2)
    old = spark.createDataFrame([(k, rnd.randrange(9), rnd.choice("ab")) for k in range(60)], schema)
    new = spark.createDataFrame([(k, rnd.choice([None, rnd.randrange(9)]), rnd.choice(["c", None])) for k in range(40, 80)], schema)
    rules = {
        "coalescing": lambda o, n: R.merge_coalescing(o, n, ["id"]), "replacing": lambda o, n: R.merge_replacing(o, n, ["id"]), "missing": lambda o, n: R.merge_missing(o, n, ["id"]),
        "emptied": lambda o, n: o.join(n.select("id"), "id", "left_anti"),
    }
    for name, rule in rules.items():
        table = BucketedTable(spark, str(tmp_path / name), schema, ["id"], buckets=5)
        table.merge(old, lambda o, n: n, "old")
        table.merge(new, rule, "new")
        told = lambda t: sorted((r["id"], -1 if r["n"] is None else r["n"], r["seen"] or "") for r in t.collect())
        assert told(table.read()) == told(rule(old, new)), name
        table.merge(new.limit(0), rule, "nothing")
        assert told(table.read()) == told(rule(old, new)), name
    gone = BucketedTable(spark, str(tmp_path / "gone"), schema, ["id"], buckets=3)
    gone.merge(old, lambda o, n: n, "old")
    gone.merge(old, rules["emptied"], "all")
    assert gone.read().count() == 0
