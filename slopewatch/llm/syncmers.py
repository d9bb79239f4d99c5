"""Document fingerprints of closed syncmers: anchors chosen by their own inside alone, matched by hash and place."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.texts import Texts, _powers, mix, record, slices, symbol_table

INNER = 6  # bytes of an inner substring
WINDOW = 9  # inner substrings of a k-mer, so k = 14
ANCHORS = 96  # anchors kept: those of the smallest hashes over the whole text
SHORT, LEAST = 48, 4  # bytes of a short text, and of its anchors
BLOCK_ROWS, BLOCKS = 1000, 4096
_SYMBOLS = symbol_table(b"", lower=False)
_MANY = 0xD6E8FEB86659FD93
_PAIR = np.dtype([("hash", "<u4"), ("place", "<u4")])


def smallest(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The (hash, place) of the ``ANCHORS`` smallest hashes; each occurrence of an anchor counts, under a hash of its own."""
    order = np.argsort(hashes, kind="stable")
    h, places = hashes[order], places[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    again = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    own, at = np.unique((mix(h + again.astype(np.uint64) * np.uint64(_MANY)) >> np.uint64(32)).astype(np.uint32), return_index=True)
    kept = np.empty(min(len(own), ANCHORS), _PAIR)
    kept["hash"], kept["place"] = own[:ANCHORS], places[at[:ANCHORS]]
    return kept


def anchors(texts: Texts) -> list[np.ndarray]:
    """For each text the (hash, byte place) of its kept anchors, by hash.

    A k-mer is an anchor if its smallest inner substring is its first or last.
    Texts below ``SHORT`` bytes have every substring of ``LEAST`` bytes as an
    anchor, or themselves if shorter still; an empty one has none.
    """
    data, bounds = texts.data, texts.bounds
    n, k = len(data), INNER + WINDOW - 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SYMBOLS[data] * power[:n], out=sums[1:])
    at = np.zeros(0, np.int64)
    if n >= k:
        inner = mix((sums[INNER:] - sums[:-INNER]) * inverse[: n - INNER + 1])
        least, width = inner, 1
        while 2 * width <= WINDOW:
            least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
        rest = WINDOW - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        at = np.flatnonzero((least == inner[: len(least)]) | (least == inner[WINDOW - 1 :]))
        owner = np.searchsorted(bounds, at, side="right") - 1
        at = at[at + k <= bounds[owner + 1]]
    hashes = mix((sums[at + k] - sums[at]) * inverse[at])
    cut = np.searchsorted(at, bounds)
    out = []
    for i, (start, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if end - start >= SHORT:
            out.append(smallest(hashes[cut[i] : cut[i + 1]], at[cut[i] : cut[i + 1]] - start))
        else:
            size = min(LEAST, end - start)
            p = np.arange(start, end - size + 1) if size else np.zeros(0, np.int64)
            out.append(smallest(mix((sums[p + size] - sums[p]) * inverse[p]), p - start))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of anchors that two fingerprints have in common at consistent places, 0 to 1.

    Jaccard estimate over the smallest hashes of the union, as 2J / (1 + J), the
    share of common text of equally long texts. Common anchors count if their
    displacement is near the median one. Two empty ones are alike.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common, ia, ib = np.intersect1d(a["hash"], b["hash"], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if len(common) == len(a) == len(b) and np.array_equal(a["place"], b["place"]):
        return 1.0
    # the union's smallest ANCHORS hashes; beyond the smaller full sketch's end nothing is known
    ends = [x["hash"][-1] for x in (a, b) if len(x) == ANCHORS]
    end = min(ends) if ends else np.uint32(0xFFFFFFFF)
    union = np.searchsorted(a["hash"], end, side="right") + np.searchsorted(b["hash"], end, side="right")
    shift = a["place"][ia].astype(np.int64) - b["place"][ib].astype(np.int64)
    reach = 16 + max(int(a["place"].max()), int(b["place"].max())) // 8
    inside = common <= end
    same = int((inside & (np.abs(shift - np.median(shift)) <= reach)).sum())
    jaccard = same / max(int(union) - int(inside.sum()), 1)
    return 2 * jaccard / (1 + jaccard)


def shown(anchors: np.ndarray) -> str:
    return base64.b64encode(anchors.tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def with_next(docs: DataFrame) -> DataFrame:
    """(block, guest, doc_id, text) such that each row's successor by doc_id is the next row of its partition.

    Blocks are ranges of doc_id between cut points that are ids themselves, so
    the first rows of a block are known by their id alone and go, as guests, to the
    end of the block before (of the first block, to that of the last). Texts are
    shuffled once. Null ids come first; equal ids are ordered by text.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_key"))
    blocks = min(max(docs.count() // BLOCK_ROWS, 1), BLOCKS)
    shares = F.array(*[F.lit(i / blocks) for i in range(blocks)])
    cuts = sorted(set(keyed.agg(F.percentile_approx("_key", shares, F.lit(20 * blocks + 1000)).alias("c"), F.min("_key").alias("m")).select(F.array_union("c", F.array("m"))).first()[0] or []))
    if not cuts:
        return keyed.select(F.lit(0).alias("block"), F.lit(False).alias("guest"), "doc_id", "text")
    # two short searches instead of one long: which group of cuts, then which cut
    wide = max(int(len(cuts) ** 0.5), 1)
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    upto = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col("_key")))
    found = keyed.withColumn("_g", upto(longs([g[0] for g in groups]))).withColumn("_cuts", F.element_at(F.array(*[longs(g) for g in groups]), F.col("_g")))
    block = (F.col("_g") - 1) * wide + upto(F.col("_cuts")) - 1
    starts = F.element_at(F.col("_cuts"), block - (F.col("_g") - 1) * wide + 1) == F.col("_key")
    home = F.struct(block.cast("int").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(block - 1, F.lit(len(cuts))).cast("int").alias("block"), F.lit(True).alias("guest"))
    dealt = found.select("doc_id", "text", F.explode(F.when(starts, F.array(home, guest)).otherwise(F.array(home))).alias("_at"))
    return dealt.select("_at.block", "_at.guest", "doc_id", "text").repartition("block").sortWithinPartitions("block", "guest", "doc_id", "text")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likeness to it and to the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next). Null text counts as empty: no anchors, an empty
    fingerprint. A single document follows itself. Repeated rows are neighbours
    of each other; extra columns are ignored; empty input gives no rows.
    """

    def judged(rows: list[tuple]) -> pa.RecordBatch | None:
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        if not own:
            return None
        change = [edited(rows[i][3], rows[i + 1][3]) for i in own]
        whole, new = anchors(Texts.of([r[3] for r in rows])), anchors(Texts.of(change))
        return record(
            doc_id=pa.array([rows[i][2] for i in own], pa.int64()), n_chars=np.array([len(rows[i][3]) for i in own], np.int64),
            edited_sha256=pa.array([hashlib.sha256(c.encode()).hexdigest() for c in change]),
            fingerprint=pa.array([shown(whole[i]) for i in own]), edited_fingerprint=pa.array([shown(x) for x in new]),
            near_edited=np.array([likeness(whole[i], x) for i, x in zip(own, new, strict=True)]),
            near_next=np.array([likeness(whole[i], whole[i + 1]) for i in own]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            for part in slices(batch):
                rows = last + list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                out = judged(rows)
                if out is not None:
                    yield out
                last = rows[-1:]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)
