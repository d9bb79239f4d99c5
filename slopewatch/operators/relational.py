"""Latest-row, merge and set helpers used across the jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A lookup side may be broadcast only up to this many bytes of estimated size.
BROADCAST_LIMIT = 64 * 1024 * 1024
# ... or, where its rows are counted, up to this many of them.
BROADCAST_ROWS = 100_000


def small_enough(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    """Is the optimiser's size estimate of the plan below the limit?"""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= limit


def lookup_join(df: DataFrame, table: DataFrame, on: Sequence[str] | str, how: str = "left") -> DataFrame:
    """Join with a broadcast hint only where the lookup side is known to be small."""
    return df.join(F.broadcast(table) if small_enough(table) else table, on, how)


def few_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Has the table at most ``limit`` rows? Each task stops counting there."""
    return df.limit(limit + 1).count() <= limit


def sized_join(df: DataFrame, table: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Broadcast ``table`` if its counted rows are few, else a sort-merge join.

    For sides whose estimate says little: Spark takes an exploded side for as small as the
    compressed file it comes from, broadcasts it and fills the driver's memory.
    """
    return df.join(table.hint("broadcast" if few_rows(table) else "merge"), on, how)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Row with the greatest order tuple per key.

    ``max`` of a struct combines on the map side, so a hot key shrinks to one
    row per task before the shuffle; a window would move all its rows.
    """
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max(F.struct(rank.alias("_o"), F.struct(*rest).alias("_v"))).alias("_x")
    )
    return best.select(*keys, "_x._v.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def merge_coalescing(old: DataFrame, new: DataFrame, keys: Sequence[str],
                     maps: Sequence[str] = (), latest: Sequence[str] = ()) -> DataFrame:
    """New non-null values win, nulls keep the old ones; map columns are united."""
    cols = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    out = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    for c in cols:
        if c not in new.columns:
            out.append(F.col(f"o.{c}"))
        elif c not in old.columns:
            out.append(F.col(f"n.{c}"))
        elif c in maps:
            a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
            kept = F.map_filter(a, lambda k, v: ~F.coalesce(F.map_contains_key(b, k), F.lit(False)))
            out.append(F.coalesce(F.map_concat(kept, b), b, a).alias(c))
        elif c in latest:
            out.append(F.greatest(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def merge_replacing(old: DataFrame, new: DataFrame, keys: Sequence[str],
                    keep_old: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace old rows of the same key; ``keep_old`` columns prefer a new non-null."""
    if keep_old:
        prior = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep_old])
        new = new.join(prior, list(keys), "left").withColumns(
            {c: F.coalesce(F.col(c), F.col(f"_old_{c}")) for c in keep_old}
        ).drop(*[f"_old_{c}" for c in keep_old])
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*old.columns))


def merge_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append only the rows whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def merge_accumulating(old: DataFrame, new: DataFrame, keys: Sequence[str], counts: Sequence[str],
                       greatest: Sequence[str]) -> DataFrame:
    """Counts add up, last-seen columns take the greatest, others coalesce."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    out = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    for c in old.columns:
        if c in keys:
            continue
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in counts:
            out.append((F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(c))
        elif c in greatest:
            out.append(F.greatest(a, b).alias(c))
        else:
            out.append(F.coalesce(b, a).alias(c))
    return joined.select(*out)


def replace_slice(old: DataFrame, new: DataFrame, slice_keys: Sequence[str], scope: Column | None = None) -> DataFrame:
    """Delete the old rows of the slices that ``new`` brings (inside ``scope``), then append."""
    doomed = old.filter(scope) if scope is not None else old
    kept = doomed.join(new.select(*slice_keys).distinct(), list(slice_keys), "left_anti")
    if scope is not None:
        kept = kept.unionByName(old.filter(~F.coalesce(scope, F.lit(False))))
    return kept.unionByName(new.select(*old.columns))


def optional_filter(df: DataFrame, **equals: object) -> DataFrame:
    """Add an equality filter for each argument that is set."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def content_version(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order-independent content hash per dataset.

    Row hashes are counted (copies of one row become one entry) and folded with
    xor, which combines on the map side; no task ever holds a data set.
    """
    row = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c not in by])), 256)
    counted = df.select(*by, row.alias("_h")).groupBy(*by, "_h").agg(F.count(F.lit(1)).alias("_n"))
    entry = F.sha2(F.concat_ws(":", "_h", F.col("_n").cast("string")), 256)
    words = [F.conv(F.substring(entry, 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(4)]
    folded = counted.groupBy(*by).agg(
        *[F.bit_xor(w).alias(f"_w{i}") for i, w in enumerate(words)], F.sum("_n").alias("rows")
    )
    digest = F.sha2(F.concat_ws("-", *[F.col(f"_w{i}").cast("string") for i in range(4)]), 256)
    return folded.select(*by, digest.alias("version"), "rows")


def unchanged(current: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Versions to load: those that differ from the *latest* registered one."""
    last = latest_per_key(registry, keys, ["fetched_at"]).select(*keys, F.col("version").alias("_last"))
    joined = current.join(last, list(keys), "left")
    return joined.withColumn("skip", F.coalesce(F.col("version") == F.col("_last"), F.lit(False))).drop("_last")


def most_recent(df: DataFrame, keys: Sequence[str], when: str) -> DataFrame:
    """Latest value of one column per key."""
    return df.groupBy(*keys).agg(F.max(when).alias(when))
