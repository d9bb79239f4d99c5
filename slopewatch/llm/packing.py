"""Best-fit packing: configuration LP over the length histogram by multiplicative weights, then rounded."""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.llm.texts import SMALL_SLICE, map_texts, record, stored
from slopewatch.llm.tokens import WordTokens

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END = (0).to_bytes(4, "little")
ROUNDS = 240  # knapsacks of a linear program, at most
SEEDS = 12  # patterns taken from each
STEP = 0.5  # share of the scarcest length's demand that a round covers
ETA = 4.0  # how strongly cover lowers a length's price
LOOSE = 200_000  # pieces left over that best fit may place one by one
CELLS = 4096  # parts of a length's pieces that are numbered on their own, at most (about)

Pattern = tuple[tuple[int, int], ...]  # (length, pieces of it)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids and a final 0."""
    path = path or public_tokenizers.path(VOCABULARY)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = WordTokens.at(path)
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = tokens.ids(text) + END
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part))
        columns = list(zip(*rows, strict=True))
        out = {n: pa.array(c, t) for n, c, t in zip(("doc_id", "piece", "start", "length", "ids_crc32"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))}
        return record(**out, **({"ids": pa.array(columns[5], pa.binary())} if keep_ids else {}))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return map_texts(docs.select("doc_id", "text"), work, schema, most=SMALL_SLICE)


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """For every room the number of the length to take first in its most valuable filling, -1 for none."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        value = best[c - lengths[: fits[c]]] + price[: fits[c]]
        i = int(value.argmax())
        if value[i] > best[c - 1]:
            best[c], chosen[c] = value[i], i
        else:
            best[c] = best[c - 1]
    return chosen


def filling(lengths: np.ndarray, chosen: np.ndarray, room: int) -> dict[int, int]:
    """Pieces by number of their length in the most valuable filling of a room."""
    pattern: dict[int, int] = {}
    while room > 0:
        i = int(chosen[room])
        if i < 0:
            room -= 1
        else:
            pattern[i] = pattern.get(i, 0) + 1
            room -= int(lengths[i])
    return pattern


def configuration_lp(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> dict[Pattern, float]:
    """Fractional uses of patterns that cover every length's demand.

    Prices start at the lengths' share of the capacity, the dual of the volume
    bound, and fall exponentially with what a length has been covered. Each
    round prices by one knapsack and takes from it, for each of the least covered
    lengths, the most valuable pattern with that length, used for ``STEP`` of its
    scarcest demand.
    """
    cover, uses = np.zeros(len(lengths)), {}
    for _ in range(ROUNDS):
        needy = np.lexsort((-lengths, cover))[:SEEDS]
        if cover[needy[0]] >= 1:
            break
        chosen = knapsack(lengths, lengths / capacity * np.exp(-ETA * np.minimum(cover, 2.0)), capacity)
        for i in needy:
            pattern = filling(lengths, chosen, capacity - int(lengths[i]))
            pattern[int(i)] = pattern.get(int(i), 0) + 1
            at, many = np.array(list(pattern)), np.array(list(pattern.values()))
            step = STEP * (demand[at] / many).min()
            cover[at] += many * step / demand[at]
            key = tuple(sorted((int(lengths[j]), n) for j, n in pattern.items()))
            uses[key] = uses.get(key, 0.0) + step
    return uses


def packed(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns with whole uses that take every piece exactly once.

    The LP's uses are rounded up as far as pieces are left, the largest first; what
    rounding leaves is solved again while that places much of it. At most
    ``LOOSE`` pieces are placed by best fit decreasing at the end; beyond that the
    best pattern of all is used as often as it can be, again and again. Work
    depends on the number of different lengths, not of pieces.
    """
    left = {int(n): int(k) for n, k in histogram.items() if k}
    out: list[tuple[Pattern, int]] = []
    if capacity in left:
        out.append((((capacity, 1),), left.pop(capacity)))

    def use(pattern: Pattern, times: int) -> None:
        out.append((pattern, times))
        for n, k in pattern:
            left[n] -= k * times
            if not left[n]:
                del left[n]

    moving = True
    while left and moving:
        before = sum(left.values())
        lengths = np.array(sorted(left))
        uses = configuration_lp(lengths, np.array([left[n] for n in lengths], float), capacity)
        for pattern, x in sorted(uses.items(), key=lambda u: (-u[1], u[0])):
            times = min(int(np.ceil(x)), *(left.get(n, 0) // k for n, k in pattern))
            if times:
                use(pattern, times)
        moving = sum(left.values()) < 0.7 * before and sum(left.values()) > LOOSE
    while sum(left.values()) > LOOSE:
        lengths = np.array(sorted(left))
        found = filling(lengths, knapsack(lengths, lengths / capacity, capacity), capacity)
        pattern = tuple((int(lengths[i]), min(k, left[int(lengths[i])])) for i, k in sorted(found.items()))
        use(pattern, min(left[n] // k for n, k in pattern))
    out.extend((tuple(sorted(p.items())), 1) for p in best_fit(left, capacity))
    return out


def best_fit(histogram: Mapping[int, int], capacity: int) -> list[dict[int, int]]:
    """Best fit decreasing: each piece goes to the fullest sequence that has room."""
    bins: list[dict[int, int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has room r
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fit = rooms >> n
            if fit:
                room = n + (fit & -fit).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, b = capacity, len(bins)
                bins.append({})
            bins[b][n] = bins[b].get(n, 0) + 1
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def slots(plan: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For the r-th piece of a length: runs of places, sorted by (length, first rank of the run)."""
    rows, rank, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for n, k in pattern:
            rows.append((n, rank.get(n, 0), sequence, k, offset))
            rank[n] = rank.get(n, 0) + k * times
            offset += n * k
        sequence += times
    length, first, base, many, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return {"key": length << 44 | first, "first": first, "base": base, "many": many, "offset": offset}


def placed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``parts(doc_id, piece, start, length, ...)`` with ``sequence_id, offset``.

    The driver gets the histogram only, ``capacity`` rows at most. Pieces of a length
    are numbered inside hashed cells, whose sizes are counted first, so a length
    that a third of the pieces share is spread over many tasks.
    """
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(packed(histogram, capacity))
    cell = max(500, sum(histogram.values()) // CELLS)
    spark = parts.sparkSession
    spread = spark.createDataFrame([(n, -(-k // cell)) for n, k in histogram.items()], "length long, cells int")
    dealt = parts.join(F.broadcast(spread), "length").withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece"), F.col("cells"))).drop("cells")
    sizes = dealt.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "_cell", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "start"))
    # a row per length and cell: CELLS and a few per length, so their number is bounded
    ranked = dealt.withColumn("_n", number).join(F.broadcast(before), ["length", "_cell"]).withColumn("_rank", F.col("_before") + F.col("_n") - 1)
    shared = spark.sparkContext.broadcast(places)
    names = parts.columns

    def work(batches):
        p = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            run = np.searchsorted(p["key"], length << 44 | rank, side="right") - 1
            k = rank - p["first"][run]
            made = {"sequence_id": p["base"][run] + k // p["many"][run], "offset": p["offset"][run] + k % p["many"][run] * length}
            yield record(**{c: batch.column(c) for c in names}, **made)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(work, schema)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """All documents as pieces with their places in sequences of at most ``capacity`` tokens.

    Text is tokenised once; the pieces are stored in the shared folder without
    text. Null and empty texts are the single id 0. Repeated rows are packed as
    often as they occur; null doc_id is kept; extra columns are ignored; empty
    input gives no rows.
    """
    return placed(stored(pieces(docs, path, capacity, keep_ids), "pieces"), capacity)
