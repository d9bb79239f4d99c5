"""Quality score: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.texts import SMALL_SLICE, SPACE, Texts, bounded_sample, map_texts, mix, record, segment_sums, slices, symbol_table

BITS = 18  # hashed features
LEARN_DOCS = 6000  # labelled documents of each class learned from, at most (about)
SHARDS = 6
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.3, 1.0
THRESHOLD = 0.3

_SYMBOLS = symbol_table(SPACE, lower=True)
#: 1 letters and bytes beyond ASCII, 2 digits, 3 marks, 0 spaces.
_KINDS = np.array([0 if b in SPACE else 2 if 48 <= b < 58 else 1 if b >= 128 or chr(b).isalpha() else 3 for b in range(256)], np.uint8)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts in order and their bounds by text.

    Words are runs of letters, of digits or of marks, so that ``WORD!!`` is two.
    Per word: itself, the pair with its predecessor, and the shapes (case, or the
    marks themselves) of three in a row. A word equal to the one two places back
    or just before counts as one symbol, so repetition shows whatever the word is.
    """
    w = texts.words(_SYMBOLS, _KINDS)
    if not len(w.hashes):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    text, h = w.text_of, w.hashes
    kind = _KINDS[texts.data[w.starts]]
    capital = lambda at: (texts.data[at] >= 65) & (texts.data[at] <= 90)
    shape = np.where(kind == 3, h, (kind + 4 * capital(w.starts) + 8 * capital(w.ends - 1)).astype(np.uint64))

    def back(values: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(values)
        out[k:] = values[:-k]
        out[k:][text[k:] != text[:-k]] = 0
        return out

    word = np.where((h == back(h, 1)) | (h == back(h, 2)) & (kind == 1), np.uint64(1), h)
    pair = word * np.uint64(3) + back(word, 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)
    triple = shape + back(shape, 1) * np.uint64(0x9E3779B97F4A7C15) + back(shape, 2) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(11)
    each = np.stack([mix(word.copy()), mix(pair), mix(triple)], axis=1).ravel()
    return (each >> np.uint64(64 - BITS)).astype(np.int64), w.bounds * 3


class Leader:
    """Follow-the-regularised-leader with a rate per coordinate; weights are exact zeros until evidence passes L1."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[np.ndarray, np.ndarray, int]] = []
    for batch in (part for whole in batches for part in slices(whole, most=SMALL_SLICE)):
        index, bounds = features(Texts.of_column(batch.column("text")))
        for i, y in enumerate(batch.column("y").to_pylist()):
            at, count = np.unique(index[bounds[i] : bounds[i + 1]], return_counts=True)
            x = count / np.sqrt(max(bounds[i + 1] - bounds[i], 1))
            rows.append((np.append(at, 1 << BITS).astype(np.int32), np.append(x, 1.0).astype(np.float32), y))
    if rows:
        leader = Leader()
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                leader.learn(*rows[i])
        w = leader.weights(slice(None))
        at = np.flatnonzero(w)
        yield record(at=at, w=w[at], shards=np.ones(len(at), np.int64))
        yield record(at=np.array([-1]), w=np.array([0.0]), shards=np.array([1]))


def learned(docs: DataFrame, labels: DataFrame, most: int = LEARN_DOCS) -> np.ndarray:
    """Weights (the bias last) from ``labels(doc_id, quality)``.

    A bounded sample of ``most`` labelled documents of each class, chosen by hash, is dealt to
    shards; each trains alone and the weights are averaged. The driver gets one
    weight per hashed feature at most. Null labels and labels of no document are
    skipped; without any, all weights are 0 and every score is 0.5.
    """
    chosen = bounded_sample(labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("y is not null"), "y", most)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # two longs for each of the bounded sample
    dealt = known.withColumn("_shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SHARDS))).repartition(SHARDS, "_shard").sortWithinPartitions("doc_id", "y")
    parts = dealt.select("text", "y").mapInArrow(_train, "at long, w double, shards long")
    got = parts.groupBy("at").agg(F.sum("w").alias("w"), F.sum("shards").alias("shards")).toArrow()
    at, w, shards = (got.column(c).to_numpy() for c in ("at", "w", "shards"))
    weights = np.zeros((1 << BITS) + 1)
    weights[at[at >= 0]] = w[at >= 0] / max(shards[at < 0].sum(), 1)
    return weights


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row's whole text: likelihood of label 1.

    The score is a sparse dot product through the logistic function. Null, empty
    and blank texts get the score of the bias. Null doc_id and repeated rows are
    kept; extra columns are ignored; empty input gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = shared.value
        index, bounds = features(Texts.of_column(batch.column("text")))
        margin = segment_sums(w[index], bounds) / np.sqrt(np.maximum(np.diff(bounds), 1)) + w[-1]
        return record(doc_id=batch.column("doc_id"), score=1 / (1 + np.exp(-np.clip(margin, -30, 30))))

    return map_texts(docs.select("doc_id", "text"), work, "doc_id long, score double", most=SMALL_SLICE)


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = shared.value
        index, bounds = features(Texts.of_column(batch.column("text")))
        margin = segment_sums(w[index], bounds) / np.sqrt(np.maximum(np.diff(bounds), 1)) + w[-1]
        return batch.filter(pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))) >= threshold))

    return map_texts(docs.select(*columns), work, docs.schema, most=SMALL_SLICE)
