"""Registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from slopewatch.llm import automaton, covertree, langid, licences, lines, mixing, neardup, packing, periodic, phrases, quality, syncmers, toxicity
from slopewatch.llm.texts import held_out, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learned(docs.filter(~held_out(F.col("doc_id"), 4, 2)))
    return langid.identified(docs, model).withColumn("held_out", held_out(F.col("doc_id"), 4, 2))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprinted(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.judged(table(spark, sf_dir, "documents"))
    named = ("copy_of_doc", "copy_of_line", "near_doc", "near_line")  # -1: none
    return got.select("doc_id", "line_no", "n_words", "kept", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in named])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.learned(docs, labels.filter(~held_out(F.col("doc_id"), 5, 0)))
    return quality.scored(docs, weights).withColumns(
        {"held_out": held_out(F.col("doc_id"), 5, 0), "predicted": (F.col("score") >= quality.THRESHOLD).cast("int")}
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.learned(docs, labels.filter(~held_out(F.col("doc_id"), 4, 2)))
    return toxicity.scored(docs, index).withColumns(
        {"held_out": held_out(F.col("doc_id"), 4, 2), "predicted": (F.col("score") >= toxicity.THRESHOLD).cast("int")}
    )


def op8_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.grouped(table(spark, sf_dir, "embeddings"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(table(spark, sf_dir, "documents"), k=2)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = automaton.encoded(table(spark, sf_dir, "documents"), spelled=True)
    return got.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


def repeated_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's edit of one document in ten by its id: words from some place on repeat with a period."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % (1 + (n - a) // (3 + g % 8)))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic.collapsed(table(spark, sf_dir, "documents"), repeated_words)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("l"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, F.concat(r.period.cast("string"), F.lit("\n")))))
    return got.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.s")).alias("start"), F.col("_best.l").alias("length"), (-F.col("_best.p")).alias("period"),
        F.expr("1000 * _best.l div -_best.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language": op1_language, "op2_packing": op2_packing, "op3_fingerprints": op3_fingerprints, "op4_mixing": op4_mixing, "op5_lines": op5_lines, "op6_quality": op6_quality,
            "op7_toxicity": op7_toxicity,
            "op8_vector_duplicates": op8_vector_duplicates, "op9_near_duplicates": op9_near_duplicates, "op10_licences": op10_licences, "op11_phrases": op11_phrases,
            "op12_tokens": op12_tokens, "op13_runs": op13_runs, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.SQL, "op5_lines": lines.SQL, "op8_vector_duplicates": covertree.SQL, "op9_near_duplicates": neardup.SQL, "op11_phrases": phrases.SQL,
            "op13_runs": periodic.SQL}
