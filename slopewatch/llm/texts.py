"""Whole texts as byte arrays: words, hashes and Arrow plumbing shared by the corpus operators.

Texts of a batch stay one byte array with bounds per text; words, hashes and
sums are array operations over all of them. Separators are always ASCII, so
bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewatch.session import prepare, shared_path

SLICE_BYTES = 1 << 21  # text handled at once; one longer text is handled alone
SMALL_SLICE = 1 << 19  # the same where a byte of text takes some 50 bytes of arrays
POWER_STEP = 1 << 16  # entries by which the power tables grow
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = bytes([0x20, *range(0x09, 0x0E)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on unsigned 64-bit hashes."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def symbol_table(separators: bytes, lower: bool) -> np.ndarray:
    """Random 64-bit value per byte, 0 for a separator; capitals as small letters if asked."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
    values = values[LOWER] if lower else values
    values[list(separators)] = 0
    return values


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in ((0, _P), (1, _P_INV)):
            steps = np.full(-(-n // POWER_STEP) * POWER_STEP, np.uint64(base))
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Texts:
    """Texts as one array of UTF-8 bytes; text ``i`` is ``data[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        raw = [(t or "").encode() for t in texts]
        bounds = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=bounds[1:])
        return cls(np.frombuffer(b"".join(raw), np.uint8), bounds)

    @classmethod
    def of_column(cls, column: pa.Array) -> Texts:
        column = column.fill_null("") if column.null_count else column
        if len(column) == 0 or column.buffers()[2] is None:
            return cls(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        return cls(np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0])

    def words(self, table: np.ndarray, kinds: np.ndarray | None = None) -> Words:
        """Maximal runs of bytes that ``table`` gives a value, never across texts.

        With ``kinds``, a class per byte, a run also ends where the class changes.
        """
        value = table[self.data]
        inside = value != 0
        first, last = self.bounds[:-1], self.bounds[1:]
        full = last > first
        opens, closes = inside.copy(), inside.copy()
        kind = inside if kinds is None else kinds[self.data]
        change = kind[1:] != kind[:-1]
        opens[1:] &= change
        closes[:-1] &= change
        opens[first[full]] = inside[first[full]]
        closes[last[full] - 1] = inside[last[full] - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        power, inverse = _powers(len(value) + 1)
        value *= power[: len(value)]
        sums = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
        return Words(hashes, starts, ends, np.searchsorted(starts, self.bounds), sums, inverse)


class Words:
    """Word hashes in order; text ``i`` has the words ``bounds[i]`` to ``bounds[i + 1]``."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, sums: np.ndarray, inverse: np.ndarray) -> None:
        self.hashes, self.starts, self.ends, self.bounds = hashes, starts, ends, bounds
        self._sums, self._inverse = sums, inverse

    def beginnings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of more than ``n`` bytes and hashes of their first ``n``; never equal to a word's."""
        at = np.flatnonzero(self.ends - self.starts > n)
        start = self.starts[at]
        return at, mix((self._sums[start + n] - self._sums[start]) * self._inverse[start] + np.uint64(n))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def text_of(self) -> np.ndarray:
        """Number of the text that each word lies in."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``k`` words in a row and the number of their text.

        A text with fewer words, but at least one, has its whole sequence as one.
        """
        n, text = self.counts, self.text_of
        h = np.zeros(len(self.hashes), np.uint64)
        for j in range(k):
            part, m = np.zeros_like(h), max(len(h) - j, 0)
            part[:m] = self.hashes[j:]
            part[:m][text[j:] != text[:m]] = 0  # words of the next text do not count
            h = h * np.uint64(_P) + part
        place = np.arange(len(h)) - self.bounds[text]
        keep = place <= np.maximum(n[text] - k, 0)
        return mix(h[keep] + np.minimum(n[text[keep]], k).astype(np.uint64)), text[keep]


def split_words(texts: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bounds) of ``Texts.words``, with working memory for ``SLICE_BYTES`` however long a text is.

    The bytes are read in steps; a word across two steps gets the hash of its parts.
    """
    data, n = texts.data, len(texts.data)
    cuts = np.zeros(n + 1, bool)  # texts begin or end here
    cuts[texts.bounds] = True
    sums: list[np.ndarray] = []
    opens: list[np.ndarray] = []
    closes: list[np.ndarray] = []
    for at in range(0, n, SLICE_BYTES):
        to = min(at + SLICE_BYTES, n)
        value = table[data[at:to]]
        inside = np.empty(to - at + 2, bool)  # with the bytes before and after
        inside[1:-1] = value != 0
        inside[0] = at > 0 and table[data[at - 1]] != 0
        inside[-1] = to < n and table[data[to]] != 0
        cut = cuts[at : to + 1]
        first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        last = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        power, inverse = _powers(SLICE_BYTES + 1)
        value *= power[: len(value)]
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        begun = bool(inside[0] and inside[1] and not cut[0])  # a word goes on from the step before
        if begun:
            first = np.r_[0, first]
        going = len(first) > len(last)  # a word goes on in the next step
        part = (total[np.r_[last, len(value)] if going else last] - total[first]) * inverse[first]
        if begun:
            length = at - opens[-1][-1] if len(opens[-1]) else 0
            sums[-1][-1:] += part[:1] * np.uint64(pow(_P, int(length), 1 << 64))
            first, part = first[1:], part[1:]
        sums.append(part)
        opens.append(first + at)
        closes.append(last + at)
        while len(opens) > 1 and not len(opens[-1]):  # all of this step belongs to an earlier word
            opens.pop(), sums.pop()
    if not sums:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    starts, ends = np.concatenate(opens), np.concatenate(closes)
    return mix(np.concatenate(sums)), starts, ends, np.searchsorted(starts, texts.bounds)


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    """Is the document kept out of learning? Checksum of the id as text, modulo ``parts``; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each ``key`` at most: those whose hash falls below the key's rate.

    Rows are chosen by the hash of their id, so reruns agree. One count per key
    is kept; ``key`` has few values.
    """
    rates = {r[key]: r["count"] for r in rows.groupBy(key).count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    below = F.lit(False)
    for value, n in rates.items():
        below = below | ((F.col(key) == F.lit(value)) & (draw < most / n))
    return rows.filter(below)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]`` in double precision."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice have ``most`` bytes at most, or are one longer text."""
    bounds = Texts.of_column(batch.column(text)).bounds
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """``work`` on slices of the rows; memory is bounded by slice and batch, whatever the partition.

    A process outlives its task, so Arrow gives back what it keeps for reuse.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, text, most):
                    out = work(part)
                    if out is not None and len(out):
                        yield out
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def record(**columns: object) -> pa.RecordBatch:
    """Record batch of arrays by name."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus operators: the library's, and Arrow batches bounded in bytes."""
    prepare(spark)
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")):
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows once to the shared folder and go on from there, free of lineage.

    The shuffle files of the write are removed at its end, so that the disk holds those of one step and not of all.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = shared_path(spark, label), spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)
