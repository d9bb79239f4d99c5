"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.texts import Texts, bounded_sample, map_texts, record, stored, symbol_table

LEARN_DOCS = 2500  # labelled documents of each class in the index, at most (about)
TERMS = 512  # vocabulary: the terms most dependent on the label, at most
MIN_DOCS = 4  # examples that hold a term
MIN_CHI2, MIN_SHARE = 20.0, 0.01  # a term's dependence on the label: beyond chance, and for this share of all examples (chi-square by their number)
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes of a word's beginning that are terms of their own
LEVELS = 3
NEIGHBOURS = 16
BLOCK = 64  # examples of an index block
DOUBT = 0.5  # weight of the prior against the neighbours' votes
THRESHOLD = 0.3

_SYMBOLS = symbol_table(bytes(b for b in range(128) if not chr(b).isalpha()), lower=True)


def terms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of their beginnings (inflected forms share one), and the number of their text."""
    words = texts.words(_SYMBOLS)
    text, parts, of = words.text_of, [words.hashes], [words.text_of]
    for n in BEGINNINGS:
        at, h = words.beginnings(n)
        parts.append(h)
        of.append(text[at])
    return np.concatenate(parts), np.concatenate(of)


def term_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (term, pos, docs): documents of the slice that hold a term, and those labelled 1 among them."""
    h, text = terms(Texts.of_column(batch.column("text")))
    y = batch.column("y").to_numpy()
    at = np.lexsort((h, text))
    text, h = text[at], h[at]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    term, place = np.unique(h[new], return_inverse=True)
    return record(term=term.view(np.int64), pos=np.bincount(place, y[text[new]], len(term)).astype(np.int64), docs=np.bincount(place, minlength=len(term)).astype(np.int64))


@dataclass
class Vocabulary:
    """Sorted term hashes with a bitmap in front. Dimension ``level * len + term``: the term occurs more than ``level`` times."""

    terms: np.ndarray
    maybe: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Vocabulary:
        maybe = np.zeros(1 << 20, bool)
        maybe[hashes & np.uint64((1 << 20) - 1)] = True
        return cls(np.sort(hashes), maybe)

    @property
    def size(self) -> int:
        return len(self.terms) * LEVELS

    def vectors(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, dimension, count) by text and dimension."""
        m = len(self.terms)
        if not m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, text = terms(texts)
        hit = np.flatnonzero(self.maybe[h & np.uint64((1 << 20) - 1)])
        h, text = h[hit], text[hit]
        term = np.minimum(np.searchsorted(self.terms, h), m - 1)
        known = self.terms[term] == h
        key, n = np.unique(text[known] * self.size + term[known], return_counts=True)
        key = np.concatenate([key[n > level] + level * m for level in range(LEVELS)])
        n = np.concatenate([n[n > level] for level in range(LEVELS)])
        order = np.argsort(key, kind="stable")
        return key[order] // self.size, key[order] % self.size, n[order]


def unit(text: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights (1 + log count) x idf of length 1 per text."""
    w = (1 + np.log(n)) * idf[term]
    if not len(w):
        return w
    return w / np.sqrt(np.bincount(text, w * w))[text]


@dataclass
class Index:
    """Postings by (term, block of examples) with the greatest weight of each block."""

    vocabulary: Vocabulary
    idf: np.ndarray
    example: np.ndarray  # of each posting
    weight: np.ndarray
    first: np.ndarray  # postings of (term, block) start here
    most: np.ndarray  # (term, block) greatest weight
    doc_id: np.ndarray  # of the examples, by leading term and id
    toxic: np.ndarray
    vote: np.ndarray  # labelled documents that an example stands for
    prior: float  # share of label 1 among labelled documents without any term

    @classmethod
    def of(cls, vocabulary: Vocabulary, idf: np.ndarray, doc_id: np.ndarray, toxic: np.ndarray, vote: np.ndarray,
           example: np.ndarray, term: np.ndarray, n: np.ndarray, prior: float) -> Index:
        weight = unit(example, term, n, idf)
        # examples of one leading term side by side, so that a block's greatest weights are told apart
        leading = np.zeros(len(doc_id), np.int64)
        rising = np.argsort(weight, kind="stable")
        leading[example[rising]] = term[rising]
        order = np.lexsort((doc_id, leading))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        example, doc_id, toxic, vote = place[example], doc_id[order], toxic[order], vote[order]
        blocks = -(-len(doc_id) // BLOCK)
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order]
        cell = term * blocks + example // BLOCK
        first = np.searchsorted(cell, np.arange(vocabulary.size * blocks + 1))
        most = np.zeros(vocabulary.size * blocks)
        np.maximum.at(most, cell, weight)
        return cls(vocabulary, idf, example, weight, first, most.reshape(vocabulary.size, blocks), doc_id, toxic, vote, prior)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (ties: smaller number), exactly.

        Blocks go by falling upper bound; once the k-th cosine exceeds the bound of all blocks left, they cannot matter.
        """
        bound = weight @ self.most[term]
        blocks = np.argsort(-bound, kind="stable")
        blocks = blocks[bound[blocks] > 0]
        best, cosine = np.zeros(0, np.int64), np.zeros(0)
        at, many = 0, 8
        while at < len(blocks):
            part = blocks[at : at + many]
            at, many = at + many, 2 * many
            if len(best) == k and bound[part[0]] < cosine[-1] - 1e-12:
                break
            cell = (term[:, None] * self.most.shape[1] + part).ravel()
            n = self.first[cell + 1] - self.first[cell]
            place = np.arange(n.sum()) + np.repeat(self.first[cell] - (np.cumsum(n) - n), n)
            found, back = np.unique(self.example[place], return_inverse=True)
            sums = np.bincount(back, self.weight[place] * np.repeat(np.repeat(weight, len(part)), n), len(found))
            best, cosine = np.append(best, found), np.append(cosine, sums)
            top = np.lexsort((best, -np.round(cosine, 12)))[:k]
            best, cosine = best[top], cosine[top]
        return best, np.minimum(cosine, 1.0)

    def judged(self, term: np.ndarray, n: np.ndarray) -> tuple[float, list[int]]:
        """Score and evidence (doc_id of the nearest examples) for a text's terms and counts."""
        w = (1 + np.log(n)) * self.idf[term]
        near, cosine = self.nearest(term, w / np.sqrt(w @ w))
        vote = cosine**2 * self.vote[near]
        doubt = DOUBT * (self.vote.mean() if len(self.vote) else 1.0)
        return float((vote @ self.toxic[near] + doubt * self.prior) / (vote.sum() + doubt)), self.doc_id[near].tolist()


def learned(docs: DataFrame, labels: DataFrame, most: int = LEARN_DOCS) -> Index:
    """Index over a bounded sample of ``labels(doc_id, toxic)``, ``most`` documents of each class, by hash.

    The vocabulary are the terms of those examples that depend most on the label;
    document frequencies for IDF count all of ``docs``. The driver gets the
    vocabulary's counts and the examples' vectors, bounded by ``TERMS`` and ``most``.
    A class that the sample thins out has its votes weighed up again. Null labels
    and labels of no document are skipped; without examples every score is 0.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("y is not null")
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    rows = docs.select("doc_id", "text").join(F.broadcast(bounded_sample(known, "y", most)), "doc_id")  # two longs for each of the bounded sample
    sample = stored(rows, "examples")
    kept = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, n = kept.get(1, 0), sum(kept.values())
    counts = map_texts(sample.select("text", "y"), term_counts, "term long, pos long, docs long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("docs").alias("docs"))
    a, d = F.col("pos").cast("double"), F.col("docs").cast("double")
    gap = a * n - d * pos
    chi2 = gap * gap * n / F.nullif(d * (n - d) * F.lit(float(pos)) * F.lit(float(n - pos)), F.lit(0.0))
    chosen = counts.withColumn("chi2", chi2).filter((d >= MIN_DOCS) & (F.col("chi2") >= max(MIN_CHI2, MIN_SHARE * n))).orderBy(F.desc("chi2"), "term").limit(TERMS)
    vocabulary = Vocabulary.of(np.array([r["term"] for r in chosen.select("term").collect()], np.int64).view(np.uint64))
    size = vocabulary.size

    def frequencies(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, term, _ = vocabulary.vectors(Texts.of_column(batch.column("text")))
        found = np.bincount(term, minlength=size)
        return record(term=np.flatnonzero(found), n=found[found > 0])

    def examples(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, term, count = vocabulary.vectors(Texts.of_column(batch.column("text")))
        cut = np.searchsorted(text, np.arange(len(batch) + 1)).astype(np.int32)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int64)))
        return record(doc_id=batch.column("doc_id"), y=batch.column("y"), term=lists(term), n=lists(count))

    df = np.zeros(size)
    for r in map_texts(docs.select("text"), frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    idf = np.log((docs.count() + 1) / (df + 1)) + 1
    got = map_texts(sample, examples, "doc_id long, y int, term array<long>, n array<long>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = got.column("y").to_numpy()
    stands = np.array([total.get(c, 0) / max(kept.get(c, 0), 1) for c in (0, 1)])[y] if len(y) else np.zeros(0)
    length = np.array([len(t) for t in got.column("term").to_pylist()], np.int64)
    full = length > 0
    flat = lambda c: got.column(c).combine_chunks().flatten().to_numpy()
    prior = float((stands * y)[~full].sum() / stands[~full].sum()) if (~full).any() else float((stands * y).sum() / stands.sum()) if len(y) else 0.0
    return Index.of(vocabulary, idf, got.column("doc_id").to_numpy()[full], y[full].astype(float), stands[full], np.repeat(np.arange(full.sum()), length[full]), flat("term"), flat("n"), prior)


def scored(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, evidence) of every row's whole text: likelihood of label 1 and the nearest examples.

    Text that is null, empty or holds no term of the vocabulary gets the share of
    label 1 among such examples, without evidence. Null doc_id and repeated rows are kept; extra columns are ignored; empty
    input gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    judged: dict[bytes, tuple[float, list[int]]] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        text, term, n = index.vocabulary.vectors(Texts.of_column(batch.column("text")))
        cut = np.searchsorted(text, np.arange(len(batch) + 1))
        out = [(index.prior, [])] * len(batch)
        if len(judged) > 20_000:
            judged.clear()
        for i in np.flatnonzero(np.diff(cut)):
            a, b = term[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]]
            key = a.tobytes() + b.tobytes()
            if key not in judged:
                judged[key] = index.judged(a, b)
            out[i] = judged[key]
        return record(doc_id=batch.column("doc_id"), score=np.array([s for s, _ in out]), evidence=pa.array([e for _, e in out], pa.list_(pa.int64())))

    return map_texts(docs.select("doc_id", "text"), work, "doc_id long, score double, evidence array<long>")
