"""Language identification by partial matching: code lengths under byte context trees, one per language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.texts import LOWER, Texts, bounded_sample, map_texts, record, segment_sums

DEPTH = 5  # bytes of a gram: a context of up to four and the byte after it
LEARN_DOCS = 600  # documents learned from in each language, at most (about)
UNKNOWN = "und"

#: Letters as small letters and all bytes beyond ASCII as they are; the rest is one space.
FOLD = np.array([LOWER[b] if LOWER[b] in range(97, 123) or b >= 128 else 32 for b in range(256)], np.uint8)


def folded(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with runs of spaces as one; every text follows a zero byte. Start of each text, end of the last."""
    data = FOLD[texts.data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    first = texts.bounds[:-1]
    keep[first[first < len(data)]] = True
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    bounds = kept[texts.bounds] + np.arange(len(texts.bounds))
    out = np.zeros(bounds[-1], np.uint8)
    inside = np.ones(len(out), bool)
    inside[bounds[:-1]] = False
    out[inside] = data[keep]
    return out, bounds


def gram_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (lang, k, gram, n): k-grams of the texts, first byte highest."""
    lang = np.array(batch.column("lang").to_pylist(), object)
    columns: list[list] = [[], [], [], []]
    for name in dict.fromkeys(lang):
        data, _ = folded(Texts.of_column(batch.column("text").filter(pa.array(lang == name))))
        gram, whole = np.zeros(len(data), np.uint64), np.ones(len(data), bool)
        for k in range(1, DEPTH + 1):
            m = max(len(data) - k + 1, 0)
            gram, whole = (gram[:m] << np.uint64(8)) | data[k - 1 :], whole[:m] & (data[k - 1 :] != 0)
            found, n = np.unique(gram[whole], return_counts=True)
            for column, part in zip(columns, ([name] * len(found), np.full(len(found), k), found.astype(np.int64), n), strict=True):
                column.extend(part)
    return record(lang=pa.array(columns[0], pa.string()), k=pa.array(columns[1], pa.int32()), gram=pa.array(columns[2], pa.int64()), n=pa.array(columns[3], pa.int64()))


@dataclass
class Model:
    """Union of the languages' context trees; node 0 of a level is "not seen".

    ``step[k][node, code]`` is the child of a k-gram; ``cost[k][node]`` the code
    length in bits of the gram's last byte after its other bytes, per language;
    ``escape[k][node]`` the bits to leave the k-gram as a context.
    """

    langs: list[str]
    code: np.ndarray
    step: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of every byte in every language, with escapes (method C)."""
        code = self.code[data]
        node = self.step[0][0, code]
        bits = self.cost[1][node]
        for k in range(2, DEPTH + 1):
            if len(data) < k:
                break
            context = node[: len(data) - k + 1]
            node = self.step[k - 1][context, code[k - 1 :]]
            longer = np.where((node != 0)[:, None], self.cost[k][node], bits[k - 1 :] + self.escape[k - 1][context])
            bits[k - 1 :] = longer
        return bits


def build(langs: list[str], lang: np.ndarray, k: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Trees and frozen code lengths from gram counts (``lang`` as a number)."""
    seen = np.unique(gram[k == 1]).astype(np.int64)
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(1, len(seen) + 1)
    width, m = len(seen) + 1, len(langs)
    grams, counts = [np.zeros(0, np.int64)], [np.zeros((0, m))]
    for level in range(1, DEPTH + 1):
        rows = k == level
        values, place = np.unique(gram[rows], return_inverse=True)
        table = np.zeros((len(values) + 1, m))
        np.add.at(table, (place + 1, lang[rows]), n[rows])
        grams.append(values)
        counts.append(table)

    def node(level: int, values: np.ndarray) -> np.ndarray:
        return np.zeros(len(values), np.int64) if level == 0 else np.searchsorted(grams[level], values) + 1

    step, cost, escape = [], [np.full((1, m), 8.0)], []
    for level in range(1, DEPTH + 1):
        values = grams[level]
        above = 1 if level == 1 else len(grams[level - 1]) + 1
        parent = node(level - 1, values >> 8)
        child = np.zeros((above, width), np.int32)
        child[parent, code[values & 255]] = np.arange(1, len(values) + 1)
        total, kinds = np.zeros((above, m)), np.zeros((above, m))
        np.add.at(total, parent, counts[level][1:])
        np.add.at(kinds, parent, counts[level][1:] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            direct = np.log2((total + kinds)[parent] / counts[level][1:])
        shorter = cost[level - 1][node(level - 1, values & ((1 << 8 * (level - 1)) - 1))]
        own = np.where(counts[level][1:] > 0, direct, leave[parent] + shorter)
        unseen = leave[:1] + 8.0 if level == 1 else np.zeros((1, m))
        step.append(child)
        escape.append(leave)
        cost.append(np.concatenate([unseen, own]))
    return Model(langs, code, step, [c.astype(np.float32) for c in cost], [e.astype(np.float32) for e in escape])


def learned(docs: DataFrame, most: int = LEARN_DOCS) -> Model:
    """Trees from documents with text and lang: ``most`` of each language, chosen by hash.

    The driver gets gram counts of that bounded sample only.
    """
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    sample = bounded_sample(known, "lang", most)
    counts = map_texts(sample.select("text", "lang"), gram_counts, "lang string, k int, gram long, n long")
    got = counts.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, number = np.unique(np.array(got.column("lang").to_pylist(), str), return_inverse=True)
    return build([str(x) for x in langs], number, *(got.column(c).to_numpy() for c in ("k", "gram", "n")))


def scored(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = Texts.of_column(batch.column("text"))
    data, bounds = folded(texts)
    n = np.diff(bounds) - 1
    ascii_letter = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 97) & (data < 123), out=ascii_letter[1:])
    letters = ascii_letter[bounds[1:]] > ascii_letter[bounds[:-1]]
    for i in np.flatnonzero(~letters):  # no a-z: other alphabets, digits, empty texts
        letters[i] = any(c.isalpha() for c in batch.column("text")[i].as_py() or "")
    if not model.langs:
        return record(lang_pred=pa.array([UNKNOWN] * len(n)), score=np.zeros(len(n)), bits_per_byte=np.zeros(len(n)))
    bits = model.bits(data)
    bits[bounds[:-1]] = 0
    total = segment_sums(bits, bounds)
    best = total.argmin(axis=1)
    # shorter by x bits is likelier by 2^x; tempered by the root of the length, as bytes are not independent
    gap = (total - total.min(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
    score = 1 / np.exp2(-gap).sum(axis=1)
    names = np.array([*model.langs, UNKNOWN], object)[np.where(letters, best, len(model.langs))]
    return record(lang_pred=pa.array(names, pa.string()), score=np.where(letters, score, 0.0), bits_per_byte=np.where(letters, total.min(axis=1) / np.maximum(n, 1), 0.0))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every row's whole text.

    The language whose tree gives the shortest code; ties go to the first by
    name. Text that is null, empty or without a letter of any alphabet: ``und``
    and 0, as for a model without languages. Null doc_id and repeated rows are
    kept; extra columns are ignored; empty input gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = scored(shared.value, batch)
        return record(doc_id=batch.column("doc_id"), **{c: got.column(c) for c in got.schema.names})

    return map_texts(docs.select("doc_id", "text"), work, "doc_id long, lang_pred string, score double, bits_per_byte double")
