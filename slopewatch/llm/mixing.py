"""Mixing sources to target weights: repetition rate per source, floor plus one seeded draw per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.llm.texts import stored, unused

WEIGHTS = (5, 2, 1)
MOST = 3.0  # repetitions of a source at most
DRAWS = 32  # seeds tried for each source
WORD = r"[^\x20\x09-\x0D]+"
#: First draw of a document for a seed: 32 bits of a digest, in [0, 1).
DRAW_SQL = "(conv(substr(md5(concat({seed}, ':', coalesce(cast(doc_id as string), ''))), 1, 8), 16, 10) / 4294967296.0D)"


def size_of(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, size)``.

    Sources in code-point order, null last, take the weights in turn. The words
    of the whole input are shared by weight; a target stops at ``most`` times the
    source's size and the excess is shared anew. That level is found at once:
    sources reach their ceiling in the order of ceiling by weight, so the first k
    are at it where the level left to the rest stays below their ceilings.
    A source without words has target 0. The windows see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights)).cast("int") + 1)
    ceiling = F.col("source_size") * F.lit(float(most))
    ranked = per.withColumn("weight", weight).withColumn("ceiling", ceiling).withColumn("turn", ceiling / F.col("weight"))
    upto = Window.orderBy("turn", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("ceiling").over(upto), F.lit(0.0))
    shares = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    levels = ranked.withColumn("level", left / shares)
    # further on the levels only fall, so the first one that holds is the greatest
    level = F.max(F.when(F.col("level") <= F.col("turn"), F.col("level"))).over(whole)
    return levels.select("source", "source_size", F.coalesce(F.least(level * F.col("weight"), F.col("ceiling")), F.col("ceiling")).alias("target"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = MOST, draws: int = DRAWS) -> DataFrame:
    """Every row of ``docs(doc_id, text, source)`` with ``size, source_size, target, copies, taken``.

    A document's rate is its source's target by size. It is taken floor(rate)
    times, and once more where its hash draw under the source's seed lies below
    the fraction. The draw of a document depends on its id and the seed only, so
    reruns agree; each source takes that of ``draws`` seeds whose total comes
    nearest its target (ties: the smaller seed). Sums per (source, task) are
    combined before the shuffle, so a hot source is no hot task.

    Null text or no words: size 0, taken 0. Null source: a source of its own.
    Null doc_id: drawn as the empty string. Repeated rows are drawn alike.
    Empty input: no rows. Extra columns go through, but those of the result's names are replaced.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    base = docs.drop(*made)
    sizes = stored(base.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    aims = stored(targets(sizes, weights, most), "targets")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    rated = sizes.join(_small(aims), sizes["source"].eqNullSafe(aims["source"])).select(sizes["source"], "doc_id", "size", "target", rate.alias("rate"))
    fraction = F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(F.expr(DRAW_SQL.format(seed=s)) < fraction, F.col("size")).otherwise(0)).alias(f"d{s}") for s in range(draws)]
    sums = rated.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.floor("rate") * F.col("size")).alias("whole"), *extra)
    miss = [F.struct(F.abs(F.col("whole") + F.col(f"d{s}") - F.col("target")).alias("miss"), F.lit(s).alias("seed")) for s in range(draws)]
    seeds = stored(sums.select("source", F.array_min(F.array(*miss))["seed"].alias("seed")), "seeds")
    plan = stored(aims.join(seeds, aims["source"].eqNullSafe(seeds["source"])).select(aims["*"], "seed"), "plan")
    key, seed = unused("_source", base), unused("_seed", base)
    keyed = plan.withColumnsRenamed({"source": key, "seed": seed})
    chosen = F.expr(DRAW_SQL.format(seed=seed)) < rate - F.floor(rate)
    copies = (F.floor(rate) + F.when(chosen, 1).otherwise(0)).cast("int")
    sized = base.withColumn("size", size_of(F.col("text")))
    out = sized.join(_small(keyed), sized["source"].eqNullSafe(F.col(key))).withColumn("copies", copies)
    return out.select(*base.columns, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emitted(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: every document ``copies`` times, in the columns of ``docs``; size-0 documents are never taken."""
    columns = docs.columns
    taken = mixed(docs, **options).filter("taken > 0")
    return taken.withColumn(unused("_copy", taken), F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[c for c in columns if c in taken.columns])


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a stored table with a row per source where its size on disk is known to be small."""
    from slopewatch.operators.relational import small_enough

    return F.broadcast(df) if small_enough(df) else df


#: The same rows in SQL. The draws under every seed are summed per source before one is chosen.
SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * 3.0::DOUBLE AS ceiling FROM per
), levels AS (
  SELECT *, ceiling / weight AS turn,
    (sum(source_size) OVER () - coalesce(sum(ceiling) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM ranked WINDOW before AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aims AS (
  SELECT source, source_size, coalesce(least((max(level) FILTER (WHERE level <= turn) OVER ()) * weight, ceiling), ceiling) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.source, s.size, a.source_size, a.target, coalesce(a.target / nullif(a.source_size, 0), 0) AS rate
  FROM sizes s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), drawn AS (
  SELECT r.*, k.seed, ('0x' || substr(md5(k.seed || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM rated r, (SELECT CAST(range AS INTEGER) AS seed FROM range({DRAWS})) k
), tried AS (
  SELECT source, seed, abs(sum(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)) - min(target)) AS miss
  FROM drawn GROUP BY source, seed
), seeds AS (
  SELECT source, seed FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, seed) = 1
)
SELECT d.doc_id, d.size, d.source_size, d.target,
  CAST(d.size * (floor(d.rate) + CASE WHEN d.draw < d.rate - floor(d.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn d JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source AND d.seed = s.seed
"""
