"""Phrase collocations: level by level through broadcast double-array tries of Apriori-safe candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.llm.texts import Texts, map_texts, mix, record, split_words, stored, symbol_table
from slopewatch.llm.trie import DEAD, ROOT, DoubleArray

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
TOP = 2000  # phrases returned per language
SCALE = 2_000_000
MOST_NODES = 4_000_000  # words or phrases that one broadcast holds; more go round in parts
ROW_IDS = 1 << 16  # ids in a stored row, about
SALTS = 64  # parts of a language that are ranked on their own first
NO_WORD = -1  # a rare word or the end of a piece

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_SYMBOLS = symbol_table(b" \t" + PIECE_ENDS, lower=True)
_WHOLE = symbol_table(b"", lower=False)
_ENDS = np.isin(np.arange(256), np.frombuffer(PIECE_ENDS, np.uint8))
_BUCKET_BITS = 12


class Stretch:
    """Words of some texts in order: keys that hold the language, and where a piece begins."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.texts = Texts.of_column(batch.column("text"))
        hashes, self.starts, self.ends, bounds = split_words(self.texts, _SYMBOLS)
        self.count = np.diff(bounds)
        coded = batch.column("lang").dictionary_encode()
        self.langs = coded.dictionary
        seeds, _, _, whole = split_words(Texts.of_column(self.langs), _WHOLE)
        told = np.zeros(len(self.langs), np.uint64)
        told[np.diff(whole) > 0] = seeds
        self.lang = np.repeat(coded.indices.to_numpy(), self.count)
        self.keys = mix(hashes ^ mix(told + np.uint64(1))[self.lang]).astype(np.int64)
        text = np.repeat(np.arange(len(self.count)), self.count)
        piece = np.searchsorted(np.flatnonzero(_ENDS[self.texts.data]), self.starts)
        self.opens = np.ones(len(self.keys), bool)
        self.opens[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])


def _distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, key, word, n) of a batch's words, and per language one row without word for all of them."""
    s = Stretch(batch)
    keys, first, n = np.unique(s.keys, return_index=True, return_counts=True)
    starts, length = s.starts[first], (s.ends - s.starts)[first]
    place = np.concatenate([[0], np.cumsum(length)])
    within = np.arange(place[-1]) - np.repeat(place[:-1], length)
    data = s.texts.data[np.repeat(starts, length) + within]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    words = pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(place.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    total = np.bincount(s.lang, minlength=len(s.langs)).astype(np.int64)
    return record(
        lang=pa.concat_arrays([s.langs.take(pa.array(s.lang[first])), s.langs]), key=np.r_[keys, np.zeros(len(total), np.int64)],
        word=pa.concat_arrays([words, pa.nulls(len(total), pa.string())]), n=np.r_[n, total],
    )


def word_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Words that occur ``least`` times in their language as (key, lang, word, n, id), and (lang, n) of all words.

    Occurrences are summed per batch, then per task, then by word. Ids number the
    words by key: buckets of keys are counted first and numbered each on its own.
    """
    rows = map_texts(docs, _distinct, "lang string, key long, word string, n long")
    counted = stored(rows.groupBy("lang", "key", "word").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("word").isNull()), "words")
    bucket = F.shiftright("key", 64 - _BUCKET_BITS)
    often = counted.filter("word is not null").withColumn("bucket", bucket)
    sizes = sorted((r["bucket"], r["count"]) for r in often.groupBy("bucket").count().collect())
    before, at = [], 0
    for b, n in sizes:  # a row per bucket: 2 ** _BUCKET_BITS at most
        before.append((b, at))
        at += n
    offsets = docs.sparkSession.createDataFrame(before, "bucket long, before long")
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "lang", "word")) - 1
    numbered = often.join(F.broadcast(offsets), "bucket").withColumn("id", (F.col("before") + number).cast("int")).drop("bucket", "before")
    return stored(numbered, "numbered"), counted.filter("word is null").select("lang", "n")


def _ids(batch: pa.RecordBatch, stretch: Stretch, keys: np.ndarray, first: int) -> np.ndarray:
    """Ids of the words among ``keys``, counted from ``first``; those that the batch has already stay."""
    old = b"".join(v or b"" for v in batch.column("ids").to_pylist())
    ids = np.frombuffer(old, np.int32).copy() if old else np.full(len(stretch.keys), NO_WORD, np.int32)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, stretch.keys), len(keys) - 1)
        hit = keys[at] == stretch.keys
        ids[hit] = at[hit] + first
    return ids


def _marked(batch: pa.RecordBatch, keys: np.ndarray, first: int) -> pa.RecordBatch:
    """The batch with the ids of its words as far as they are known."""
    stretch = Stretch(batch)
    ids, bounds = _ids(batch, stretch, keys, first), np.r_[0, np.cumsum(stretch.count)]
    told = pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
    return record(text=batch.column("text"), lang=batch.column("lang"), ids=told)


def _runs(batch: pa.RecordBatch, keys: np.ndarray, first: int) -> pa.RecordBatch | None:
    """Ids of neighbouring frequent words, two and more, each run followed by ``NO_WORD``; rows of about ``ROW_IDS``."""
    stretch = Stretch(batch)
    ids = _ids(batch, stretch, keys, first)
    known = ids >= 0
    joins = np.zeros(len(ids) + 1, bool)  # the word before belongs to the same run
    joins[1:-1] = known[1:] & known[:-1] & ~stretch.opens[1:]
    kept = known & (joins[:-1] | joins[1:])
    if not kept.any():
        return None
    ends = kept & ~joins[1:]
    place = np.cumsum(kept) + np.cumsum(ends) - ends
    out = np.full(int(kept.sum() + ends.sum()), NO_WORD, np.int32)
    out[place[kept] - 1] = ids[kept]
    after = np.flatnonzero(out == NO_WORD) + 1  # rows end with runs
    cuts = np.unique(np.r_[0, after[np.minimum(np.searchsorted(after, np.arange(ROW_IDS, len(out), ROW_IDS)), len(after) - 1)], len(out)])
    return record(ids=pa.array([out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))


def streams(docs: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """Rows of ids: the runs of frequent words of many texts.

    Keys are broadcast, at most ``most`` at a time; further keys go round again over the
    stored rows.
    """
    spark, n = docs.sparkSession, words.count()
    rows = docs.withColumn("ids", F.lit(None).cast("binary"))
    for part, first in enumerate(range(0, max(n, 1), most)):
        own = words.filter((F.col("id") >= first) & (F.col("id") < first + most)).select("key").toArrow().column("key").to_numpy()
        keys = spark.sparkContext.broadcast(np.sort(own))  # ids go by key
        if first + most < n:
            rows = stored(map_texts(rows, lambda b, keys=keys, first=first: _marked(b, keys.value, first), "text string, lang string, ids binary"), f"marked-{part}")
        else:
            rows = stored(map_texts(rows, lambda b, keys=keys, first=first: _runs(b, keys.value, first), "ids binary"), "streams")
        keys.destroy()
    return rows


class Phrases:
    """Double-array trie of phrases; a word is two symbols, the halves of its id, so that symbols stay few."""

    def __init__(self, words: int, levels: list[np.ndarray]) -> None:
        """All single words 0 to ``words`` - 1 and the rows of ``levels[j]``, of ``j + 2`` words, whose beginnings are in the level before."""
        self.bits = (max(words - 1, 1).bit_length() + 1) // 2
        self.trie = DoubleArray()
        for rows in [np.arange(words)[:, None], *levels]:
            state = np.full(len(rows), ROOT, np.int32)
            for j in range(rows.shape[1] - 1):
                state = self.step(state, rows[:, j])
            half, of = np.unique(np.stack([state, rows[:, -1] >> self.bits], axis=1), axis=0, return_inverse=True)
            middle = self.trie.add(half[:, 0], half[:, 1])
            self.trie.add(middle[of.ravel()], rows[:, -1] & ((1 << self.bits) - 1))

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """States after one more word, ``DEAD`` where no phrase goes on so."""
        return self.trie.step(self.trie.step(state, word >> self.bits), word & ((1 << self.bits) - 1))


def extensions(ids: np.ndarray, trie: Phrases, k: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of ``k`` words whose first and last ``k - 1`` words are in the trie, one a row, and how often each occurs.

    The states of all positions move at once, word by word; a position whose state
    and whose right neighbour's are both alive accepts. Only phrases whose first word's id
    leaves ``part`` when divided by ``parts`` are looked for; the trie holds those
    alone, so what follows is asked of the last words only where it can be.
    """
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros((0, k), np.int32), np.zeros(0, np.int64)
    state = np.full(len(ids), ROOT, np.int32)
    for j in range(k - 1):
        state[: len(ids) - j] = trie.step(state[: len(ids) - j], ids[j:])
        state[len(ids) - j :] = DEAD
    alive = state != DEAD
    follows = alive[1:] | (ids[1:] % parts != part) if parts > 1 else alive[1:]
    at = np.flatnonzero(alive[:n] & follows[:n] & (ids[k - 1 :] >= 0) & (ids[:n] % parts == part))
    accepting, first, local = np.unique(state[at].astype(np.int64) << 32 | ids[at + k - 1], return_index=True, return_inverse=True)
    return ids[at[first][:, None] + np.arange(k)], np.bincount(local, minlength=len(accepting))


def _columns(k: int) -> list[str]:
    return [f"w{j + 1}" for j in range(k)]


def counted_phrases(rows: DataFrame, words: int, least: int, most: int, longest: int = LONGEST) -> list[DataFrame]:
    """Tables (w1, ..., wk, n) of all phrases of 2 to ``longest`` words that occur ``least`` times.

    A phrase that often has beginnings and ends that occur as often, so level k
    looks only for what extends two frequent phrases of k - 1 words. Each shard
    numbers its accepting states and counts them; shards are summed by phrase.
    Tries of more than ``most`` nodes are cut by first word and go round in parts.
    """
    spark = rows.sparkSession
    levels: list[DataFrame] = []
    sizes: list[int] = []
    for k in range(2, longest + 1):
        if levels and not sizes[-1]:
            levels.append(levels[-1].limit(0).withColumn(f"w{k}", F.lit(0)).select(*_columns(k), "n"))
            sizes.append(0)
            continue
        parts = max(1, -(-sum(sizes) // most))
        table = None
        for part in range(parts):
            own = [t.filter(F.pmod(F.col("w1"), F.lit(parts)) == part).select(*_columns(j + 2)).toArrow() for j, t in enumerate(levels)]
            shared = spark.sparkContext.broadcast(Phrases(words, [np.stack([c.to_numpy() for c in t.columns], axis=1) for t in own]))

            def work(batches, shared=shared, k=k, part=part, parts=parts):
                for batch in batches:
                    raw = batch.column("ids")
                    at = np.frombuffer(raw.buffers()[1], np.int32)[[raw.offset, raw.offset + len(raw)]]
                    phrases, n = extensions(np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[1]].view(np.int32), shared.value, k, part, parts)
                    yield record(**{c: phrases[:, j] for j, c in enumerate(_columns(k))}, n=n.astype(np.int64))

            schema = ", ".join(f"{c} int" for c in _columns(k)) + ", n long"
            found = rows.mapInArrow(work, schema).groupBy(*_columns(k)).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            found = stored(found, f"phrases-{k}")
            shared.destroy()
            table = found if table is None else table.unionByName(found)
        levels.append(table)
        sizes.append(table.count())
    return levels


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(28,0)")


def scored(words: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(p, lang, a, l, r, score) of the candidates that no longer one stands for; ``p`` are the word ids.

    Products are decimals of 38 digits. Every part of a candidate is a frequent
    word or phrase, so its count is at hand.
    """
    tables = [words.select(F.array("id").alias("p"), "n")] + [t.select(F.array(*_columns(j + 2)).alias("p"), "n") for j, t in enumerate(levels)]
    known, phrases = tables[0], tables[1]
    for t in tables[1:]:
        known = known.unionByName(t)
    for t in tables[2:]:
        phrases = phrases.unionByName(t)

    size = F.size("p")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("p", i, m))))
    longer = phrases.filter(size > 2).select(F.explode(inner).alias("p"), "n").groupBy("p").agg(F.max("n").alias("longer"))
    covered = F.coalesce(100 * _exact("longer") >= 80 * _exact("n"), F.lit(False))
    left = phrases.join(longer, "p", "left").filter(~covered).select("p", F.col("n").alias("a"))

    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("_first"), F.expr("slice(p, k + 1, size(p) - k)").alias("_rest"))
    part = lambda name, column: known.select(F.col("p").alias(name), F.col("n").alias(column))
    cuts = cuts.join(part("_first", "l"), "_first").join(part("_rest", "r"), "_rest")
    cuts = cuts.withColumn("score", F.expr(f"(cast(a as decimal(28,0)) * {SCALE}) div (cast(l as decimal(28,0)) + cast(r as decimal(28,0)))"))
    best = cuts.groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("p", "a", "b.l", "b.r", "b.score").join(words.select(F.col("id").alias("_id"), "lang"), F.expr("p[0] = _id")).drop("_id")


def ranked(words: DataFrame, totals: DataFrame, candidates: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language by score, occurrences and wording, with their texts.

    Languages are first cut into salted parts that keep their own first rows, so a
    language with most of the phrases is ranked by many tasks. Only rows whose score and
    count come that early are spelled out; those equal to the last of them come along.
    """
    salt = F.pmod(F.xxhash64("p"), F.lit(SALTS))
    early = Window.partitionBy("lang", "_salt").orderBy(F.desc("score"), F.desc("a"))
    rows = candidates.withColumn("_salt", salt).withColumn("_early", F.rank().over(early)).filter(F.col("_early") <= top).drop("_early")
    spelled = rows
    for j in range(LONGEST):
        spelled = spelled.join(words.select(F.col("id").alias(f"_id{j}"), F.col("word").alias(f"_word{j}")), F.get("p", F.lit(j)) == F.col(f"_id{j}"), "left").drop(f"_id{j}")
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", *[f"_word{j}" for j in range(LONGEST)]))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    own = spelled.withColumn("_own", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_own") <= top)
    final = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return final.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, most: int = MOST_NODES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the strongest phrases of 2 to 4 words in each language.

    Words are lower-cased in A-Z; phrases stay within pieces between marks and line
    ends. Null texts are empty, null languages are ``und``. Repeated rows count as
    often as they occur; doc_id and extra columns are not read; empty input, and
    input without frequent phrases, gives no rows. Words are told apart by 64-bit hashes of
    language and bytes. Texts are read twice; later levels read the ids of
    frequent words only.
    """
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    words, totals = word_counts(docs, least)
    rows = streams(docs, words, most)
    levels = counted_phrases(rows, words.count(), least, most)
    return ranked(words, totals, stored(scored(words, levels), "candidates"), top)


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
phrases AS (SELECT lang, w[i : i + k - 1] AS p, count(*) AS f FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
inner_parts AS (
  SELECT lang, p[i : i + m - 1] AS p, max(f) AS longer
  FROM phrases, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m) WHERE m < len(p) AND i + m - 1 <= len(p) GROUP BY ALL),
kept AS (
  SELECT lang, p, f AS a FROM phrases LEFT JOIN inner_parts USING (lang, p)
  WHERE len(p) >= 2 AND NOT coalesce(100 * CAST(longer AS HUGEINT) >= 80 * CAST(f AS HUGEINT), false)),
cuts AS (
  SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM kept) c
  JOIN phrases x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN phrases y ON y.lang = c.lang AND y.p = c.p[k + 1 : len(c.p)]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
told AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM lowest),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM told)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN total USING (lang) WHERE rank <= 2000
"""
