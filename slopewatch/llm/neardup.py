"""Near-duplicate documents: MinHash bands for candidates, odd sketches to sift them, full shingle sets to confirm.

Nodes are distinct shingle sets, so exact copies cost one row. A band's bucket
is never expanded into its pairs: its members are first held against one centre,
and only what then still lies in different components is compared again, in
blocks, by sketch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.texts import SMALL_SLICE, SPACE, Texts, map_texts, mix, record, stored, symbol_table, unused
from slopewatch.operators.components import connected

SHINGLE = 5
SIMILARITY = 80  # per cent
BANDS, ROWS = 20, 4  # a pair of similarity 0.8 shares no band with probability 3e-5
BITS = 512  # of an odd sketch
SIEVE = 0.55  # sketch estimate below which a pair of 0.8 falls with probability 1e-7
CHUNK = 1024  # members of a bucket that are compared at once

_SYMBOLS = symbol_table(SPACE, lower=True)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS + np.uint64(5)) | np.uint64(1)
_SCHEMA = "doc_id long, sid long, n long, bands array<long>, sketch array<long>"


def shingle_sets(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, and their bounds by text."""
    h, text = texts.words(_SYMBOLS).shingles(k)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def set_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit identity of each set: a sum over its members, so order does not matter."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def signed(texts: Texts, k: int) -> dict[str, np.ndarray]:
    """Per text with words: its number, set identity, set size, band keys and odd sketch."""
    h, bounds = shingle_sets(texts, k)
    full = np.flatnonzero(np.diff(bounds))
    starts = bounds[full]
    least = np.zeros((len(full), BANDS * ROWS), np.uint64)
    for i in range(BANDS * ROWS if len(full) else 0):
        least[:, i] = np.minimum.reduceat((h ^ _SEEDS[i]) * _ODD[i], starts)
    keys = np.zeros((len(full), BANDS), np.uint64)
    for r in range(ROWS):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + mix(least[:, r::ROWS].copy())
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
    # parity bitmap: every (number of the sample, sample) flips one bit
    bit = (mix(least + _SEEDS) % np.uint64(BITS)).astype(np.int64)
    flips = np.bincount((np.arange(len(full))[:, None] * BITS + bit).ravel(), minlength=len(full) * BITS).reshape(len(full), BITS) & 1
    sketch = np.packbits(flips.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
    return {"text": full, "sid": set_ids(h, bounds)[full], "n": np.diff(bounds)[full], "bands": keys.view(np.int64), "sketch": sketch}


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, sid, n, bands, sketch) of every row; without words ``sid`` is null."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, rows = signed(Texts.of_column(batch.column("text")), k), len(batch)
        at = np.full(rows, -1)
        at[s["text"]] = np.arange(len(s["text"]))
        none = at < 0
        size = np.zeros(rows, np.int64)
        size[s["text"]] = s["n"]
        sid = np.zeros(rows, np.int64)
        sid[s["text"]] = s["sid"]

        def lists(values: np.ndarray) -> pa.Array:
            cut = np.zeros(rows + 1, np.int32)
            np.cumsum(np.where(none, 0, values.shape[1]), out=cut[1:])
            return pa.ListArray.from_arrays(pa.array(cut), pa.array(values.ravel()))

        return record(doc_id=batch.column("doc_id"), sid=pa.array(sid, mask=none), n=size, bands=lists(s["bands"]), sketch=lists(s["sketch"]))

    return map_texts(docs.select("doc_id", "text"), work, _SCHEMA, most=SMALL_SLICE)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two odd sketches: the XOR's population count tells how many samples differ."""
    ones = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    share = F.least(ones / F.lit(BITS / 2), F.lit(0.999999))
    return 1 + F.log(1 - share) * (BITS / 4 / (BANDS * ROWS))


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for all rows of ``a`` against all of ``b``."""
    ones = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        ones += np.bitwise_count(a[:, j, None] ^ b[None, :, j])
    return 1 + np.log(1 - np.minimum(ones / (BITS / 2), 0.999999)) * (BITS / 4 / (BANDS * ROWS))


def _sizes_fit(a: Column, b: Column, similarity: int) -> Column:
    return 100 * F.least(a, b) >= similarity * F.greatest(a, b)


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(sid, members) of ``wanted(sid, doc_id)``: sorted shingle hashes, 6 bytes each, from the document's text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, bounds = shingle_sets(Texts.of_column(batch.column("text")), k)
        sid = set_ids(h, bounds)
        short = h.view(np.uint8).reshape(-1, 8)[:, 2:]
        members = [short[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        mine = sid == batch.column("sid").to_numpy()  # an id may stand for several texts
        return record(sid=pa.array(sid[mine]), members=pa.array([m for m, ok in zip(members, mine, strict=True) if ok], pa.binary()))

    rows = docs.select("doc_id", "text").join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("sid", "text")
    return map_texts(rows, work, "sid long, members binary", most=SMALL_SLICE).dropDuplicates(["sid"])


def _members(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def confirmed(edges: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The ``edges(a, b)`` whose full sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = _members(x.as_py()), _members(y.as_py())
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= similarity * (len(p) + len(q) - both))
            yield record(a=batch.column("a"), b=batch.column("b")).filter(pa.array(keep, pa.bool_()))

    x, y = sets.select(F.col("sid").alias("a"), F.col("members").alias("x")), sets.select(F.col("sid").alias("b"), F.col("members").alias("y"))
    return edges.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _labels(edges: DataFrame) -> DataFrame:
    """(sid, label) of every set that has a link."""
    linked = edges.select(F.lit(0).alias("scope"), "a", "b")
    nodes = linked.select("scope", F.col("a").alias("id")).union(linked.select("scope", F.col("b").alias("id"))).distinct()
    return connected(nodes, linked).select(F.col("id").alias("sid"), "label")


def common_counts(a: list[np.ndarray], b: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``: products of 0/1 matrices over their common members."""
    va, vb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out
    ca, cb = (np.minimum(np.searchsorted(both, v), len(both) - 1) for v in (va, vb))
    ka, kb = both[ca] == va, both[cb] == vb
    ra, ca, rb, cb = ra[ka], ca[ka], rb[kb], cb[kb]
    for at in range(0, len(both), width):
        part = [np.zeros((len(sets), width), np.float32) for sets in (a, b)]
        for m, r, c in zip(part, (ra, rb), (ca, cb), strict=True):
            inside = (c >= at) & (c < at + width)
            m[r[inside], c[inside] - at] = 1
        out += part[0] @ part[1].T
    return out


def _held(unit: dict[str, np.ndarray], similarity: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(a, b): each set and the one its component inside the two sides of a unit is named after; links on full sets."""
    left, right = np.flatnonzero(unit["side"] == 0), np.flatnonzero(unit["side"] == 1)
    n, m = unit["n"][left][:, None], unit["n"][right][None, :]
    fit = (unit["label"][left][:, None] != unit["label"][right][None, :]) & (100 * np.minimum(n, m) >= similarity * np.maximum(n, m))
    if fit.any():
        fit &= _estimates(unit["sketch"][left], unit["sketch"][right]) >= SIEVE
    i, j = np.flatnonzero(fit.any(axis=1)), np.flatnonzero(fit.any(axis=0))
    if not len(i):
        return []
    count = common_counts([_members(x) for x in unit["members"][left[i]]], [_members(x) for x in unit["members"][right[j]]])
    link = fit[np.ix_(i, j)] & (100 * count >= similarity * (n[i] + m[:, j] - count))
    x, y = unit["sid"][left[i]], unit["sid"][right[j]]
    lx, ly, top, moved = x.copy(), y.copy(), np.iinfo(np.int64).max, link.any()
    while moved:
        low_x = np.minimum(lx, np.where(link, ly[None, :], top).min(axis=1))
        low_y = np.minimum(ly, np.where(link, low_x[:, None], top).min(axis=0))
        moved = bool((low_x < lx).any() or (low_y < ly).any())
        lx, ly = low_x, low_y
    a, b = np.concatenate([lx, ly]), np.concatenate([x, y])
    return [(a[a != b], b[a != b])]


def _blocks(members: DataFrame, similarity: int) -> DataFrame:
    """Further (a, b) from ``members(key, sid, label, n, sketch, members)`` of buckets with several components.

    Members outside the bucket's largest component are held against all members
    of other components, chunk by chunk, full sets included; a chunk pair gives at
    most a row per set, not its pairs.
    """
    by_label = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    keys = by_label.groupBy("key").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    chunks = lambda n: F.ceil(n / CHUNK).cast("int")
    carried = ["sid", "label", "n", "sketch", "members"]
    told = members.join(keys, "key").select(
        "key", *carried, (F.col("label") != F.col("main")).alias("stray"), chunks(F.col("all")).alias("many"), chunks(F.col("all") - F.col("most")).alias("few")
    )
    own = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    others = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: place(i, own(F.col("many")), 1))
    strays = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda j: place(own(F.col("few")), j, 0))
    dealt = told.withColumn("_at", F.explode(F.when(F.col("stray"), F.concat(others, strays)).otherwise(others))).select("key", "_at.i", "_at.j", "_at.side", *carried)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: dict[str, np.ndarray] = {}

        def held(rows: dict[str, np.ndarray], whole: bool) -> pd.DataFrame:
            """Work on the units in ``rows``; the last one waits for more rows unless they are the ``whole`` rest."""
            nonlocal rest
            new = np.ones(len(rows["key"]), bool)
            new[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in ("key", "i", "j")], axis=0)
            cut = np.append(np.flatnonzero(new), len(new))
            last = len(cut) - 1 if whole else len(cut) - 2
            found = [pair for k in range(last) for pair in _held({c: v[cut[k] : cut[k + 1]] for c, v in rows.items()}, similarity)]
            rest = {c: v[cut[last] :] for c, v in rows.items()}
            a, b = (np.concatenate([pair[side] for pair in found] or [np.zeros(0, np.int64)]) for side in (0, 1))
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            if len(batch):
                rows = {c: np.stack(batch[c]) if c == "sketch" else batch[c].to_numpy() for c in batch.columns}
                yield held({c: np.concatenate([rest[c], v]) for c, v in rows.items()} if rest else rows, False)
        if rest:
            yield held(rest, True)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, "a long, b long").distinct()


def grouped(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs(doc_id, text)``.

    Words are maximal runs of non-blank characters, A-Z lower-cased; a document's
    set holds its distinct ``k``-word shingles, or its whole sequence if it has
    fewer words. Sets with intersection by union of ``similarity`` per cent are
    linked; ``component_id`` is the smallest doc_id reachable and ``kept`` marks
    it. Null, empty and blank texts have no shingles and stay alone. Null doc_ids
    count as below all others; repeated rows share everything. Extra columns are
    ignored; empty input gives no rows.
    """
    low = F.lit(-(1 << 63))
    base = docs.select(F.coalesce("doc_id", low).alias("doc_id"), "text")
    signs = stored(signatures(base, k), "signatures")
    classes = stored(signs.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    spread = classes.select("sid", F.explode("bands").alias("key"))
    centres = spread.groupBy("key").agg(F.min("sid").alias("centre"), F.max("sid").alias("_other")).filter("centre != _other").drop("_other")
    buckets = stored(spread.join(centres, "key"), "buckets")

    info = classes.select("sid", "n", "sketch")
    left = info.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = info.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    stars = buckets.filter("sid != centre").select(F.col("centre").alias("a"), F.col("sid").alias("b")).distinct()
    sifted = stars.join(right, "b").join(left, "a").filter(_sizes_fit(F.col("na"), F.col("nb"), similarity) & (estimate(F.col("sa"), F.col("sb")) >= SIEVE))
    wanted = buckets.select("sid").distinct().join(classes.select("sid", "doc_id"), "sid")
    sets = stored(full_sets(base, wanted, k), "sets")
    links = stored(confirmed(sifted.select("a", "b"), sets, similarity), "links")
    labels = stored(_labels(links), "labels")
    known = buckets.join(labels, "sid", "left").select("key", "sid", F.coalesce("label", "sid").alias("label"))
    open_keys = known.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l != h").select("key")
    members = known.join(open_keys, "key").join(info, "sid").join(sets, "sid")
    more = stored(_blocks(members, similarity), "more")
    if not more.isEmpty():
        labels = _labels(links.unionByName(more))
    ids = classes.select("sid", "doc_id").join(labels, "sid")
    named = ids.join(ids.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("sid", "component_id")
    alone = classes.join(named, "sid", "left").select("sid", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = signs.select("doc_id", "sid", "n").join(alone, "sid", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    real = lambda c: F.nullif(F.col(c), low)
    return out.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def thinned(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that are not the first of their group, all columns."""
    name = unused("_gone", docs)
    gone = stored(grouped(docs, k, similarity).filter("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")


#: The same rows in SQL: all links between different sets of shingles, then the smallest id reachable.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), n AS (
  SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS class FROM s
), rep AS (
  SELECT class, min(doc_id) AS id, min(n) AS n FROM n WHERE n > 0 GROUP BY class
), sh AS (
  SELECT r.id, r.n, unnest(s.s) AS x FROM rep r JOIN s ON s.doc_id = r.id
), links AS (
  SELECT a.id AS a, b.id AS b FROM sh a JOIN sh b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))
), pairs AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT id, id AS to_id FROM rep UNION SELECT r.id, e.b FROM reach r JOIN pairs e ON r.to_id = e.a
), comp AS (
  SELECT id, min(to_id) AS component_id FROM reach GROUP BY id
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(c.component_id, n.doc_id) AS component_id, n.doc_id = coalesce(c.component_id, n.doc_id) AS kept
FROM n LEFT JOIN rep r ON n.class = r.class AND n.n > 0 LEFT JOIN comp c ON r.id = c.id
"""
