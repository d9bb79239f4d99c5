"""Line dedup: exact copies by hash, near copies by a deletion-neighbourhood join, the earliest line kept.

Lines are sequences of words, an edit adds, removes or replaces one word. Two
lines one edit apart agree in one half, so only lines that share a half with
another line put their deletion variants into the join; no such pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.texts import SMALL_SLICE, SPACE, Texts, Words, _powers, map_texts, mix, record, stored, symbol_table, unused

MIN_WORDS = 5  # shorter lines carry too little to be called near copies
_SYMBOLS = symbol_table(SPACE, lower=True)


class Lines:
    """The non-blank lines of texts with hashes over runs of their words."""

    def __init__(self, texts: Texts) -> None:
        self.words: Words = texts.words(_SYMBOLS)
        breaks = np.flatnonzero(texts.data == 10)
        line = np.searchsorted(breaks, self.words.starts)
        text = self.words.text_of
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(line)) if len(line) else self.first
        self.n = self.last - self.first
        self.text = text[self.first]
        self.number = line[self.first] - np.searchsorted(breaks, texts.bounds[self.text])
        power, self._inverse = _powers(len(line) + 1)
        self._sums = np.zeros(len(line) + 1, np.uint64)
        np.cumsum(self.words.hashes * power[: len(line)], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words from ``start`` to before ``end``, their number included."""
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))

    def halves(self) -> list[np.ndarray]:
        """Four keys per line, of which two lines one edit apart share one.

        For the shorter length m of the two: the first m // 2 words or the last
        m - m // 2 are untouched. A line may be the shorter or the longer one.
        """
        keys = []
        for m in (self.n, self.n - 1):
            h = m // 2
            tag = mix(m.astype(np.uint64) * np.uint64(2))
            keys.append(self.hashes(self.first, self.first + h) ^ tag)
            keys.append(self.hashes(self.last - (m - h), self.last) ^ mix(m.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        return keys

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, word left out, hash) of every line without one of its words, and whole (-1)."""
        whole = np.arange(len(self.n))
        line = np.repeat(whole, self.n)
        at = np.arange(len(line))
        a, b = self.first[line], self.last[line]
        before, after = (self._sums[at] - self._sums[a]) * self._inverse[a], (self._sums[b] - self._sums[at + 1]) * self._inverse[a + 1]
        less = mix(before + after + (self.n[line] - 1).astype(np.uint64))
        return np.append(line, whole), np.append(at - a, np.full(len(whole), -1)), np.append(less, self.hashes(self.first, self.last))


def _long(h: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    return pa.array(h.view(np.int64), mask=mask)


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, n_words, line, k0..k3) of every non-blank line; no keys below ``MIN_WORDS``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(Texts.of_column(batch.column("text")))
        short = lines.n < MIN_WORDS
        keys = {f"k{i}": _long(k, short) for i, k in enumerate(lines.halves())}
        return record(
            doc_id=batch.column("doc_id").take(pa.array(lines.text)), line_no=pa.array(lines.number.astype(np.int32)), n_words=pa.array(lines.n.astype(np.int32)),
            line=_long(lines.hashes(lines.first, lines.last)), **keys,
        )

    return map_texts(docs, work, "doc_id long, line_no int, n_words int, line long, k0 long, k1 long, k2 long, k3 long", most=SMALL_SLICE)


def _within_one(a: list[str], b: list[str]) -> bool:
    """Is the edit distance of two word lists 1 or less? All but one word lie in the common beginning and end."""
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    q = next((i for i, (x, y) in enumerate(zip(reversed(short), reversed(long))) if x != y), len(short))
    return p + q >= len(long) - 1


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, n_words, line, kept, copy_of_doc, copy_of_line, near_doc, near_line) of every non-blank line.

    The order of lines is (doc_id, line_no). A line of ``MIN_WORDS`` or more words
    is kept unless an earlier one has the same words (case of A-Z aside) or is one
    word edit away; the earliest such is named. A shorter line is kept unless an
    earlier one has the same words; blank ones are not listed. Of a line that occurs several times the first counts in near
    comparisons. Null ids come first; rows that repeat an id and line are alike and share their fate;
    null and empty texts have no lines; extra columns are ignored.
    """
    low = F.lit(-(1 << 63))
    base = docs.select(F.coalesce("doc_id", low).alias("doc_id"), "text")
    lines = stored(numbered(base), "lines")
    order = F.struct("doc_id", "line_no")
    keys = [f"k{i}" for i in range(4)]
    different = stored(lines.groupBy("line").agg(F.min(order).alias("first"), *[F.first(k).alias(k) for k in keys]), "different")

    # lines that share a half with a different line
    spread = different.filter("k0 is not null").select("line", F.explode(F.array_distinct(F.array(*keys))).alias("key"))
    common = spread.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a != b").select("key")
    survivors = spread.join(common, "key").select("line").distinct().join(different.select("line", "first"), "line")
    places = stored(survivors.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("first.line_no", "line")).alias("wanted")), "places")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "wanted")), strict=True):
            parts = (text or "").split("\n")
            rows.extend((doc_id, w["line_no"], w["line"], parts[w["line_no"]]) for w in wanted if w["line_no"] < len(parts))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        out = record(doc_id=pa.array(columns[0], pa.int64()), line_no=pa.array(columns[1], pa.int32()), line=pa.array(columns[2], pa.int64()), text=pa.array(columns[3], pa.string()))
        found = Lines(Texts.of_column(out.column("text")))  # an id may stand for several texts
        mine = np.zeros(len(out), bool)
        mine[found.text] = found.hashes(found.first, found.last).view(np.int64) == out.column("line").to_numpy()[found.text]
        return out.filter(pa.array(mine))

    # the same plan at every size, so that disk grows with the input
    texts = stored(map_texts(base.join(places.hint("merge"), "doc_id"), cut, "doc_id long, line_no int, line long, text string", most=SMALL_SLICE).dropDuplicates(["line"]), "halved")

    def vary(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(Texts.of_column(batch.column("text")))
        line, word, h = lines.variants()
        of = pa.array(lines.text[line])
        return record(variant=_long(h), word=pa.array(word.astype(np.int32)), **{c: batch.column(c).take(of) for c in ("doc_id", "line_no", "line")})

    # two lines that lack the same word differ in that word only; a variant that one line has tells nothing and goes no further
    own = F.struct("doc_id", "line_no", "line")
    variants = map_texts(texts, vary, "variant long, word int, doc_id long, line_no int, line long", most=SMALL_SLICE).filter("word >= 0")
    met = variants.groupBy("variant", "word").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    replaced = variants.join(met, ["variant", "word"]).filter(F.col("least") < own).select("line", "least")
    # a whole line is one edit from every line that contains it but for a word; the later of the two has the earlier as its witness
    whole = texts.select(F.col("line").alias("variant"), own.alias("whole"))
    inside = variants.join(whole, "variant").select(F.least("whole", own).alias("least"), F.greatest("whole", own)["line"].alias("line"))
    witness = replaced.unionByName(inside).groupBy("line").agg(F.min("least").alias("near"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lambda t: t.encode().lower().split()
        for batch in batches:
            near = [_within_one(words(x), words(y)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["line", "near_doc", "near_line"]).filter(pa.array(near, pa.bool_()))

    x, y = texts.select("line", F.col("text").alias("x")), texts.select(F.col("line").alias("_near"), F.col("text").alias("y"))
    told = witness.select("line", F.col("near.line").alias("_near"), F.col("near.doc_id").alias("near_doc"), F.col("near.line_no").alias("near_line"))
    near = stored(told.join(x, "line").join(y, "_near").select("line", "x", "y", "near_doc", "near_line").mapInArrow(verify, "line long, near_doc long, near_line int"), "near")
    fate = different.select("line", "first").join(near, "line", "left")
    out = lines.drop(*keys).join(fate, "line", "left")
    copy = F.col("first") != order
    real = lambda c: F.nullif(c, low)
    return out.select(
        real(F.col("doc_id")).alias("doc_id"), "line_no", "n_words", "line", (~copy & F.col("near_line").isNull()).alias("kept"),
        real(F.when(copy, F.col("first.doc_id"))).alias("copy_of_doc"), F.when(copy, F.col("first.line_no")).alias("copy_of_line"), real(F.col("near_doc")).alias("near_doc"), "near_line",
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that are not kept, in the same columns; ``n_chars``, if there, is counted anew.

    Lines of any length are compared exactly, so that nothing is left of a whole copy. Documents that lose every word are dropped, those that had none stay.
    """
    key, listed = unused("_id", docs), unused("_gone", docs)
    dropped = judged(docs).filter("not kept").groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("line_no", "line")).alias(listed))
    names = docs.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, gone = batch.column("text").to_pylist(), batch.column(listed).to_pylist()
        lines = Lines(Texts.of_column(batch.column("text")))
        line = lines.hashes(lines.first, lines.last).view(np.int64)
        at = np.searchsorted(lines.text, np.arange(len(texts) + 1))
        keep = np.ones(len(texts), bool)
        for i, g in enumerate(gone):
            if g:
                out_of = {(x["line_no"], x["line"]) for x in g}
                mine = [k for k in zip(lines.number[at[i] : at[i + 1]].tolist(), line[at[i] : at[i + 1]].tolist(), strict=True) if k in out_of]
                out = {n for n, _ in mine}
                keep[i] = len(mine) < at[i + 1] - at[i]
                texts[i] = "\n".join(t for n, t in enumerate(texts[i].split("\n")) if n not in out)
        columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, batch.column("text").type)}
        if "n_chars" in names:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts]).cast(batch.column("n_chars").type)
        return record(**columns).filter(pa.array(keep))

    return map_texts(docs.join(dropped, docs["doc_id"].eqNullSafe(F.col(key)), "left").select(*names, listed), work, docs.schema, most=SMALL_SLICE)


#: The same rows in SQL, -1 where no line is named.
SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents
), w AS (
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM l
), lines AS (
  SELECT doc_id, line_no, CAST(len(w) AS INTEGER) AS n_words, md5(array_to_string(w, ' ')) AS line, w FROM w WHERE len(w) > 0
), different AS (
  SELECT line, min({{'d': doc_id, 'l': line_no}}) AS first, any_value(w) AS w FROM lines GROUP BY line
), long AS (
  SELECT * FROM different WHERE len(w) >= {MIN_WORDS}
), v AS (
  SELECT line, first, i, md5(array_to_string(w[1:i - 1] || w[i + 1:], ' ')) AS variant FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM long)
), met AS (
  SELECT variant, i, min(first) AS least FROM v GROUP BY variant, i
), near AS (
  SELECT line, min(least) AS near FROM (
    SELECT v.line, m.least FROM v JOIN met m ON v.variant = m.variant AND v.i = m.i WHERE m.least < v.first
    UNION ALL SELECT v.line, d.first FROM v JOIN long d ON v.variant = d.line WHERE d.first < v.first
    UNION ALL SELECT d.line, v.first FROM v JOIN long d ON v.variant = d.line WHERE v.first < d.first
  ) GROUP BY line
)
SELECT l.doc_id, l.line_no, l.n_words, d.first.d = l.doc_id AND d.first.l = l.line_no AND n.near IS NULL AS kept,
  CAST(CASE WHEN d.first <> {{'d': l.doc_id, 'l': l.line_no}} THEN d.first.d ELSE -1 END AS BIGINT) AS copy_of_doc,
  CAST(CASE WHEN d.first <> {{'d': l.doc_id, 'l': l.line_no}} THEN d.first.l ELSE -1 END AS BIGINT) AS copy_of_line,
  coalesce(n.near.d, -1) AS near_doc, CAST(coalesce(n.near.l, -1) AS BIGINT) AS near_line
FROM lines l JOIN different d ON l.line = d.line LEFT JOIN near n ON n.line = d.line
"""
