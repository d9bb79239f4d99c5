"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slopewatch.llm import covertree, langid, licences, lines, mixing, neardup, packing, quality, syncmers, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ROWS = [
    (1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (2, None, None, None, None),
    (3, "", "en", "b", 0), (None, "uno dos tres", "es", "a", 12), (None, None, None, None, None), (4, " \n\t ", "en", None, 4), (5, LONG, "en", "b", len(LONG)),
    (6, "12 34 !!", "en", "c", 8), (7, "ünö dos <|endoftext|> x", "es", "c", 20),
]
EXTRA = ("size", "target", "sid", "_gone", "_id", "_source", "_seed", "seed", "block", "key", "length", "line", "y", "label")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns({c: F.lit(7) for c in EXTRA}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 1, None), (99, 0, 1), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")


def everything(docs, labels):
    """Operator name, rows for a table of documents."""
    yield "op1", lambda d: langid.identified(d, langid.learned(d))
    yield "op2", packing.sequences
    yield "op3", syncmers.fingerprinted
    yield "op4", mixing.mixed
    yield "op5", lines.judged
    yield "op5 texts", lines.cleaned
    yield "op6", lambda d: quality.scored(d, quality.learned(d, labels))
    yield "op6 texts", lambda d: quality.accepted(d, quality.learned(d, labels))
    yield "op7", lambda d: toxicity.scored(d, toxicity.learned(d, labels))
    yield "op9", neardup.grouped
    yield "op9 texts", neardup.thinned
    yield "op10", licences.scanned


def test_defined_rows(spark, docs, labels):
    got = {name: build(docs).collect() for name, build in everything(docs, labels)}
    for name in ("op1", "op3", "op4", "op6", "op7", "op9", "op10"):
        assert len(got[name]) == len(ROWS), name
    by = lambda name, i: [r for r in got[name] if r["doc_id"] == i]
    assert {r["lang_pred"] for i in (2, 3, 4, 6) for r in by("op1", i)} == {"und"} and by("op1", 5)[0]["lang_pred"] == "en"
    assert sum(r["length"] for r in got["op2"] if r["doc_id"] == 5) == 30_001 and [r["length"] for r in by("op2", 2)] == [1]
    assert by("op3", 2)[0]["fingerprint"] == "" and len({r["fingerprint"] for r in by("op3", 1)}) == 1
    assert len(by("op5", 1)) == 2 and not by("op5", 3) and not by("op5", 4)
    assert [r["n_shingles"] for r in by("op9", 2)] == [0] and all(r["kept"] for r in by("op9", 1))
    assert by("op10", 2)[0]["n_words"] == 0 and by("op10", 2)[0]["labels"] == ""
    for name in ("op5 texts", "op6 texts", "op9 texts"):
        assert set(got[name][0].asDict()) == set(docs.columns), name
    assert len(got["op5 texts"]) == len(ROWS) and len(got["op9 texts"]) == len(ROWS)


def test_empty_tables(spark, docs, labels):
    none, no_labels = docs.limit(0), labels.limit(0)
    for name, build in everything(none, no_labels):
        assert build(none).count() == 0, name
    # no labels at all: constant scores
    assert {r["score"] for r in quality.scored(docs, quality.learned(docs, no_labels)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.scored(docs, toxicity.learned(docs, no_labels)).collect()} == {0.0}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [], 1), (None, [0.0, 1.0], 1), (11, [1.0, 0.0, 0.0], 1),
    ]
    got = covertree.grouped(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))).collect()
    assert len(got) == len(rows)
    told = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in got)
    assert told[:4] == [(-1, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]
    assert all(r[1] == 0 and r[3] for r in told[4:])
    assert covertree.grouped(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline_stages_keep_the_columns(spark, docs, labels, tmp_path):
    for name, frame in (("documents", docs.select("doc_id", "text", "lang", "source", "n_chars")), ("labels", labels)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    data = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        data = stage(spark, data, str(tmp_path))
        assert data.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        data.write.parquet(path := f"{tmp_path}/{stage.__name__}")
        data = spark.read.parquet(path)
    placed = corpus_pipeline.STAGES[-1][1](spark, data, str(tmp_path)).collect()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(placed) == len(whole) > 0
    assert sorted((r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in placed) == sorted((r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in whole)
