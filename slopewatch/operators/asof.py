"""As-of joins in linear work.

Both sides are moved once to (key, time bucket); the nearest earlier or later
right row comes from a window inside the bucket, and what lies in other
buckets is carried in as one row per bucket. No pair of rows is ever
formed, so a key with a third of all rows costs no more than its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    direction: str = "backward",
    tolerance_hours: float | None = None,
    tie: str | None = None,
    strict: bool = False,
    bucket_hours: float = 24.0,
    match: str = "match",
    into: Mapping[str, str] | None = None,
    inner: bool = False,
) -> DataFrame:
    """Append a struct ``match`` with the right row nearest in time, or null.

    ``backward`` takes the latest row at or before the left time, ``nearest``
    the closest on either side (an earlier row wins a tie). Among right rows of
    one time the smallest ``tie`` column wins. ``strict`` excludes equal times.
    ``into`` appends the values it names as columns instead, ``inner`` drops left rows without a match.
    Columns that nobody reads later are not moved.
    """
    if direction not in ("backward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    width, nearest = int(bucket_hours * HOUR_US), direction == "nearest"
    reach = None if tolerance_hours is None else int(tolerance_hours * HOUR_US)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # the time is taken after the shuffle, so that a table moved for its left and its right side is moved once
    placed = lambda df, ts: df.withColumn("_b", F.floor(us(ts) / width)).repartition(*on, "_b").withColumn("_us", us(ts))
    dated = lambda df, ts: df.filter(F.col(ts).isNotNull())

    kept = [right_ts, *[v for v in values if v != right_ts]]
    own, theirs = [c for c in left.columns if c not in on], [f"_r{i}" for i in range(len(kept))]
    tie_col = F.col(tie) if tie else F.lit(0)
    # of the rows of one instant only one can win; an instant without any tie value has none
    best = placed(dated(right, right_ts), right_ts).groupBy(*on, "_b", "_us").agg(
        F.max(tie_col.isNotNull()).alias("_valid"), *[F.min_by(v, tie_col).alias(r) for v, r in zip(kept, theirs)]
    )
    l = placed(dated(left, left_ts) if inner else left, left_ts)
    near = reach is not None and reach <= width
    carry = _next_door(best, on, theirs, width, reach, nearest) if near else _carry(l, best, on, theirs, nearest)

    # one stream of left rows, right rows and carried rows per (key, bucket)
    none_l = [F.lit(None).cast(left.schema[c].dataType).alias(f"_l{i}") for i, c in enumerate(own)]
    none_r = [F.lit(None).cast(best.schema[r].dataType).alias(r) for r in theirs]
    stream = l.select(*on, "_b", "_us", F.lit(1).alias("_side"), *[F.col(c).alias(f"_l{i}") for i, c in enumerate(own)], *none_r)
    for rows in (best.filter("_valid"), carry.repartition(*on, "_b")):
        stream = stream.unionByName(rows.select(*on, "_b", "_us", F.lit(0).alias("_side"), *none_l, *theirs))

    is_right = F.col("_side") == 0
    said = {"_at": F.when(is_right, F.col("_us")), **{f"_v{i}": F.when(is_right, F.struct(F.col(r).alias("v"))) for i, r in enumerate(theirs)}}
    stream = stream.withColumns({**said, "_order": F.when(is_right, 1).otherwise(0) if strict else F.col("_side")})
    upto = Window.partitionBy(*on, "_b").orderBy("_us", "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = stream.withColumns({f"_prev{c}": F.last(c, ignorenulls=True).over(upto) for c in said})
    if nearest:  # a left row is null there, so the first from here on is the next one
        keys = ", ".join(f"`{k}`" for k in (*on, "_b"))
        found = found.withColumns({f"_next{c}": F.expr(f"lead({c}) ignore nulls over (partition by {keys} order by _us, _order)") for c in said})
    found = found.filter(~is_right)

    behind = F.col("_prev_at").isNotNull()
    if nearest:
        back, ahead = F.col("_us") - F.col("_prev_at"), F.col("_next_at") - F.col("_us")
        behind = behind & (F.col("_next_at").isNull() | (back <= ahead))
    pick = lambda c: F.when(behind, F.col(f"_prev{c}")).otherwise(F.col(f"_next{c}")) if nearest else F.col(f"_prev{c}")
    matched = pick("_at").isNotNull()
    if reach is not None:
        matched = F.coalesce(F.abs(pick("_at") - F.col("_us")) <= reach, F.lit(False))
    if inner:
        found = found.filter(matched)
    got = {v: pick(f"_v{i}")["v"].alias(v) for i, v in enumerate(kept)}
    back_to = {c: F.col(f"_l{i}").alias(c) for i, c in enumerate(own)} | {k: F.col(k).cast(left.schema[k].dataType).alias(k) for k in on}
    if into is not None:
        more = [F.when(matched, got[v]).alias(name) for v, name in into.items()]
    else:
        more = [(F.struct(*got.values()) if inner else F.when(matched, F.struct(*got.values()))).alias(match)]
    return found.select(*[back_to[c] for c in left.columns], *more)


def _edge(name: str, theirs: Sequence[str], by) -> list:
    """Time and values of a bucket's last or first instant, null if it has none that may win."""
    return [by(F.when(F.col("_valid"), F.col(c)), "_us").alias(f"{name}{c}") for c in ("_us", *theirs)]


def _next_door(best: DataFrame, on: Sequence[str], theirs: Sequence[str], width: int, reach: int, nearest: bool) -> DataFrame:
    """A bucket's last row for the bucket after it, its first for the one before, where the tolerance spans the border."""
    ends = lambda by: best.groupBy(*on, "_b").agg(*_edge("", theirs, by))
    spans = lambda x: F.coalesce(x, F.lit(False))  # noqa: E731  a bare comparison would send a null check below the shuffle, which then is another one
    after = F.col("_b") + 1
    out = ends(F.max_by).filter(spans(F.col("_us") + reach >= after * width)).withColumn("_b", after)
    if nearest:
        out = out.unionByName(ends(F.min_by).filter(spans(F.col("_us") - reach < F.col("_b") * width)).withColumn("_b", F.col("_b") - 1))
    return out


def _carry(l: DataFrame, best: DataFrame, on: Sequence[str], theirs: Sequence[str], nearest: bool) -> DataFrame:
    """Per (key, bucket): the last right row of earlier buckets, the first of later ones."""
    row = lambda n: F.when(F.col(f"{n}_us").isNotNull(), F.struct(*[F.col(f"{n}{c}").alias(c) for c in ("_us", *theirs)])).alias(n)
    r_sum = best.groupBy(*on, "_b").agg(*_edge("_last", theirs, F.max_by), *_edge("_first", theirs, F.min_by)).select(*on, "_b", row("_last"), row("_first"))
    nil = F.lit(None).cast(r_sum.schema["_last"].dataType)
    l_sum = l.select(*on, "_b").distinct().select(*on, "_b", nil.alias("_last"), nil.alias("_first"))
    merged = r_sum.unionByName(l_sum).groupBy(*on, "_b").agg(
        F.first("_last", ignorenulls=True).alias("_last"), F.first("_first", ignorenulls=True).alias("_first")
    )
    per_key = Window.partitionBy(*on).orderBy("_b")
    earlier, later = per_key.rowsBetween(Window.unboundedPreceding, -1), per_key.rowsBetween(1, Window.unboundedFollowing)
    sides = merged.select(*on, "_b", F.last("_last", ignorenulls=True).over(earlier).alias("_before"), F.first("_first", ignorenulls=True).over(later).alias("_after"))
    both = F.array("_before", "_after") if nearest else F.array("_before")
    return sides.select(*on, "_b", F.explode(both).alias("_x")).filter("_x is not null").select(*on, "_b", "_x.*")
