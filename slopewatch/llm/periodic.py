"""Periodic runs of words: block convolution at dyadic scales by an exact integer transform."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slopewatch.llm.texts import SPACE, Texts, map_texts, mix, record, split_words, symbol_table

REPEATS = 4  # a run holds its period so often at least
SHORTEST = 6  # and so many words
PRIME, GENERATOR = 15 * (1 << 27) + 1, 31  # products of residues fit 64 bits
AT_ONCE = 1 << 19  # values transformed, compared or copied at once

_SYMBOLS = symbol_table(SPACE, lower=False)
_ROOTS: dict[tuple[int, bool], np.ndarray] = {}

Arrange = Callable[[int | None, int], np.ndarray | None]


def _roots(n: int, inverse: bool) -> np.ndarray:
    """Powers of an n-th root of unity, half a turn."""
    if (n, inverse) not in _ROOTS:
        root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
        root = pow(root, PRIME - 2, PRIME) if inverse else root
        powers, at = np.ones(max(n // 2, 1), np.uint64), 1
        while at < len(powers):
            powers[at : 2 * at] = powers[:at] * np.uint64(pow(root, at, PRIME)) % np.uint64(PRIME)
            at *= 2
        if n > AT_ONCE:  # tables of long transforms are not kept
            return powers
        _ROOTS[n, inverse] = powers
    return _ROOTS[n, inverse]


def transformed(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row (length a power of two), in bit-reversed order."""
    p, n = np.uint64(PRIME), rows.shape[1]
    out, half = rows.astype(np.uint64), n // 2
    while half:
        v = out.reshape(len(out), -1, 2, half)
        a, b = v[:, :, 0], v[:, :, 1]
        out = np.stack([(a + b) % p, (a + p - b) % p * _roots(2 * half, False) % p], axis=2).reshape(rows.shape)
        half //= 2
    return out


def restored(rows: np.ndarray) -> np.ndarray:
    """Inverse of ``transformed``."""
    p, n = np.uint64(PRIME), rows.shape[1]
    out, half = rows, 1
    while half < n:
        v = out.reshape(len(out), -1, 2, half)
        a, b = v[:, :, 0], v[:, :, 1] * _roots(2 * half, True) % p
        out = np.stack([(a + b) % p, (a + p - b) % p], axis=2).reshape(rows.shape)
        half *= 2
    return out * np.uint64(pow(n, PRIME - 2, PRIME)) % p


def mismatches(block: np.ndarray, window: np.ndarray, most: int) -> np.ndarray:
    """Sums of squared differences of each row's block and every stretch of its window, 0 where they are equal.

    Values up to ``most`` are cut into digits small enough for the products of a
    block to stay below the prime, so each digit's sum is exact; the sums of all
    digits are added.
    """
    b, n = block.shape[1], 2 * block.shape[1]
    bits = max(k for k in (8, 4, 2, 1) if b * ((1 << k) - 1) ** 2 < PRIME)
    total = np.zeros((len(block), b), np.int64)
    for shift in range(0, max(int(most).bit_length(), 1), bits):
        x, y = (block >> shift) & ((1 << bits) - 1), (window >> shift) & ((1 << bits) - 1)
        turned, padded = np.zeros((len(x), n), np.int64), np.zeros((len(x), n), np.int64)
        turned[:, :b], padded[:, : 2 * b - 1] = x[:, ::-1], y
        product = restored(transformed(turned) * transformed(padded) % np.uint64(PRIME))[:, b - 1 : 2 * b - 1].astype(np.int64)
        squares = np.zeros((len(y), 2 * b), np.int64)
        np.cumsum(y * y, axis=1, out=squares[:, 1:])
        total += (x * x).sum(axis=1)[:, None] + squares[:, b:] - squares[:, :b] - 2 * product
    return total


def _equal_steps(ids: np.ndarray, at: np.ndarray, d: np.ndarray, side: int) -> np.ndarray:
    """How many places on from ``at``, to one side, equal those ``d`` further right, without a break."""
    steps, live, width = np.zeros(len(at), np.int64), np.arange(len(at)), 16
    while len(live):
        width = min(width * 2, max(AT_ONCE // len(live), 1))
        place = (at[live] + side * steps[live])[:, None] + side * np.arange(width)
        inside = (place >= 0) & (place + d[live, None] < len(ids))
        left = np.clip(place, 0, len(ids) - 1)
        same = inside & (ids[left] == ids[np.clip(place + d[live, None], 0, len(ids) - 1)])
        run = np.where(same.all(axis=1), width, same.argmin(axis=1))
        steps[live] += run
        live = live[run == width]
    return steps


def runs(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs, by start and period.

    ``ids`` are small whole numbers of the words of several texts, no number in two
    texts; ``longest`` is the number of words of the longest text.

    At scale B, aligned blocks of B words look for themselves B to 2B - 1 words
    later. A run of a period d in that range holds its period four times, so it
    holds two neighbouring blocks at least that both find themselves at d, and
    each word of them recurs within d. So blocks with a word that does not recur
    in time, or without such a neighbour, are passed over. Blocks that lie with their
    window inside a run found at a smaller scale are too: they find multiples of
    its period only. What two neighbouring blocks find at one distance is extended
    to both sides.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    ahead = np.full(n, n + 1, np.int64)
    same = ids[order][1:] == ids[order][:-1]
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    most = int(ids.max()) + 1 if n else 0
    found = np.zeros((0, 3), np.int64)
    scale = 1
    while REPEATS * scale <= longest:
        live = ahead < 2 * scale
        near = np.zeros(len(live), bool)
        near[:-1] |= live[1:]
        near[1:] |= live[:-1]
        block = np.flatnonzero(live & near)
        by_start = found[np.argsort(found[:, 0], kind="stable")]
        reach = np.maximum.accumulate(by_start[:, 1]) if len(by_start) else np.zeros(0, np.int64)
        holder = np.zeros(len(by_start), np.int64)  # run that reaches furthest among those that start so early
        if len(by_start):
            holder = np.maximum.accumulate(np.where(by_start[:, 1] == reach, np.arange(len(by_start)), 0))

        def covering(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            """Period of the known run around [start, end), 0 for none."""
            if not len(by_start):
                return np.zeros(len(start), np.int64)
            i = np.searchsorted(by_start[:, 0], start, side="right") - 1
            return np.where((i >= 0) & (reach[i] >= end), by_start[holder[i], 2], 0)

        block = block[covering(block * scale, block * scale + 3 * scale - 1) == 0]
        hits = [np.zeros((0, 2), np.int64)]
        rows = max(AT_ONCE // (4 * scale), 1)
        for k in range(0, len(block), rows):
            starts = block[k : k + rows] * scale
            place = starts[:, None] + np.arange(3 * scale - 1)
            values = np.where(place < n, ids[np.minimum(place, n - 1)], most)  # beyond the end: a word of its own
            zero = mismatches(values[:, :scale], values[:, scale:], most) == 0
            row, d = np.nonzero(zero)
            hits.append(np.stack([block[k + row], d + scale], axis=1))
        hit = np.concatenate(hits)
        known = covering(hit[:, 0] * scale, (hit[:, 0] + 1) * scale + hit[:, 1])
        hit = hit[(known == 0) | (hit[:, 1] % np.maximum(known, 1) != 0)]
        hit = hit[np.lexsort((hit[:, 0], hit[:, 1]))]
        if len(hit):
            opens = np.r_[True, (hit[1:, 1] != hit[:-1, 1]) | (hit[1:, 0] != hit[:-1, 0] + 1)]
            first = np.flatnonzero(opens)
            last = np.r_[first[1:], len(hit)] - 1
            pair = last > first
            first, last = first[pair], last[pair]
            d = hit[first, 1]
            start = hit[first, 0] * scale
            left = start - _equal_steps(ids, start - 1, d, -1)
            stop = (hit[last, 0] + 1) * scale
            right = stop + _equal_steps(ids, stop, d, 1) + d
            good = right - left >= np.maximum(REPEATS * d, SHORTEST)
            new = np.stack([left, right, d], axis=1)[good]
            found = np.concatenate([found, np.unique(new, axis=0)])
        scale *= 2
        even = len(ahead) // 2 * 2
        ahead = np.maximum(ahead[0:even:2], ahead[1:even:2])
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):  # the same stretch: its smallest period
        found = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)]]
    return tuple(found[np.lexsort((found[:, 2], found[:, 0]))].T)


def numbered(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Small whole numbers, equal for equal words of the same text only."""
    return np.unique(mix(hashes ^ mix(text.astype(np.uint64) + np.uint64(1))), return_inverse=True)[1]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts of the words ``bounds[i]`` to ``bounds[i + 1]``, joined by one space."""
    size = ends - starts + 1
    size[bounds[1:][bounds[1:] > bounds[:-1]] - 1] -= 1  # none after a text's last word
    place = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=place[1:])
    out = np.full(place[-1], 0x20, np.uint8)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(place, place[at] + AT_ONCE, side="right")) - 1)
        length = (ends - starts)[at:to]
        within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(place[at:to], length) + within] = data[np.repeat(starts[at:to], length) + within]
        at = to
    offsets = place[bounds]
    kind, width = (pa.string(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(out)])


def collapsed(docs: DataFrame, arrange: Arrange | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row's whole text.

    ``runs`` are (start, length, period) of all maximal repetitions of words, by
    start and period; ``collapsed`` is the text without the words that a run holds
    after its first period, joined by single spaces. ``arrange(doc_id, n)`` may give
    the numbers of the words in the order in which they are to be read, ``None``
    for as they stand.

    Null, empty and blank texts have no words, no runs and an empty text. Null
    doc_id and repeated rows are kept, extra columns ignored; empty input gives
    no rows. A text is handled whole by one task, in memory of a few bytes a byte.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts.of_column(batch.column("text"))
        hashes, starts, ends, bounds = split_words(texts, _SYMBOLS)
        count = np.diff(bounds)
        if arrange is not None:
            orders = [arrange(i, int(n)) for i, n in zip(batch.column("doc_id").to_pylist(), count, strict=True)]
            if any(o is not None for o in orders):
                count = np.array([n if o is None else len(o) for n, o in zip(count, orders, strict=True)])
                read = np.concatenate([b + (np.arange(n) if o is None else o) for b, n, o in zip(bounds[:-1], count, orders, strict=True)]).astype(np.int64)
                hashes, starts, ends = hashes[read], starts[read], ends[read]
                bounds = np.r_[0, np.cumsum(count)]
        text = np.repeat(np.arange(len(texts)), count)
        start, end, period = runs(numbered(hashes, text), int(count.max(initial=0))) if len(hashes) else (np.zeros(0, np.int64),) * 3
        inside = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(inside, start + period, 1)
        np.add.at(inside, end, -1)
        kept = np.cumsum(inside[:-1]) == 0
        left = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(kept, out=left[1:])
        holder = text[start]
        fields = pa.StructArray.from_arrays([pa.array(start - bounds[holder]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
        listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(holder, np.arange(len(texts) + 1)), pa.int32()), fields)
        return record(doc_id=batch.column("doc_id"), n_words=count.astype(np.int64), runs=listed, collapsed=joined(texts.data, starts[kept], ends[kept], left[bounds]))

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_texts(docs.select("doc_id", "text"), work, schema)


#: Every pair of equal words at a distance of up to a quarter of the words, joined into maximal stretches by distance.
#: The checksum of the id is worked out bit by bit; ``raw`` and ``edited`` are the contract's edit.
SQL = r"""
WITH ids AS (
  SELECT doc_id, coalesce(text, '') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda h, c: list_reduce(list_prepend(xor(h, c), CAST(range(8) AS BIGINT[])), lambda v, k: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS h
  FROM documents),
raw AS (SELECT doc_id, h, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM ids),
sized AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS edit, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS e FROM raw),
edited AS (
  SELECT doc_id, n, CASE WHEN edit THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + e)) END]) ELSE w END AS w FROM sized),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM edited),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs),
stretches AS (SELECT doc_id, min(q) AS q, s, l FROM (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)) GROUP BY doc_id, s, l),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM stretches),
left_over AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t FROM words ANTI JOIN dropped ON words.doc_id = dropped.doc_id AND words.i = dropped.i GROUP BY words.doc_id),
told AS (
  SELECT doc_id, count(*) AS n_runs, max({'l': l, 's': -s, 'p': -q}) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM stretches GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(-best.p AS BIGINT) AS period,
  CAST(1000 * best.l // -best.p AS BIGINT) AS exponent_milli, sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(left_over.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told ON d.doc_id = told.doc_id LEFT JOIN left_over ON d.doc_id = left_over.doc_id
"""
