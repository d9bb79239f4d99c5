"""Running aggregates and exact order statistics that never put a whole key in one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in a single task,
which fails once one key holds a large share of the data. Here every key is
cut into slices (time buckets or value ranges): a window runs inside each
slice, a second one over the few slice summaries, and the two are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

def time_slice(ts: Column, width_hours: float = 24.0) -> Column:
    """Bucket number of a timestamp; the slice key of time-ordered series."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(int(width_hours * 3_600_000_000)))


def sliced_running(
    df: DataFrame,
    by: Sequence[str],
    slice_col: str,
    order: Sequence[str | Column],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    prior_maxes: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Append running sums and maxima per key, in order, across slices.

    ``slice_col`` must not decrease along the order. ``sums`` and ``maxes``
    include the current row, ``prior_maxes`` stop at the row before it.
    """
    sums, maxes, prior = dict(sums or {}), dict(maxes or {}), dict(prior_maxes or {})
    inside = Window.partitionBy(*by, slice_col).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)

    totals = [F.sum(e).alias(f"_t_{n}") for n, e in sums.items()]
    totals += [F.max(e).alias(f"_t_{n}") for n, e in {**maxes, **prior}.items()]
    summary = df.groupBy(*by, slice_col).agg(*totals)
    earlier = (
        (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
        .orderBy(slice_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = [F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums]
    carried += [F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in {**maxes, **prior}]
    carry = summary.select(*by, slice_col, *carried)

    local = df.withColumns(
        {
            **{n: F.sum(e).over(upto) for n, e in sums.items()},
            **{n: F.max(e).over(upto) for n, e in maxes.items()},
            **{n: F.max(e).over(before) for n, e in prior.items()},
        }
    )
    joined = local.alias("l").join(
        carry.alias("c"), [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*by, slice_col)], "left"
    )
    keep = [F.col(f"l.{c}").alias(c) for c in local.columns if c not in sums and c not in maxes and c not in prior]
    # greatest skips nulls, so it merges the carried and the local maximum
    grown = [(F.coalesce(F.col(f"l.{n}"), F.lit(0)) + F.coalesce(F.col(f"c._c_{n}"), F.lit(0))).alias(n) for n in sums]
    grown += [F.greatest(F.col(f"l.{n}"), F.col(f"c._c_{n}")).alias(n) for n in {**maxes, **prior}]
    return joined.select(*keep, *grown)


def numbered(df: DataFrame, by: Sequence[str], slice_col: str, order: Sequence[str | Column],
             name: str = "seq") -> DataFrame:
    """Row number per key (from 1) without one task per key."""
    return sliced_running(df, by, slice_col, order, sums={name: F.lit(1).cast("bigint")})


def blocked(df: DataFrame, by: Sequence[str], slice_col: str, order: Sequence[str | Column],
            lookback: int, block_rows: int = 200_000) -> DataFrame:
    """Cut each key into equal blocks of consecutive rows with a bounded look-back.

    The last ``lookback`` rows of a block are repeated at the head of the next
    one (``is_context``), so windows over ``(by, block)`` ordered by ``seq``
    see every row they may reach; drop the context rows afterwards.
    """
    n = numbered(df, by, slice_col, order)
    n = n.withColumn("block", F.floor((F.col("seq") - 1) / block_rows))
    tail = (F.col("seq") - 1) % block_rows >= block_rows - lookback
    copies = F.when(tail, F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("x")),
                                  F.struct((F.col("block") + 1).alias("b"), F.lit(True).alias("x")))
                    ).otherwise(F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("x"))))
    spread = n.withColumn("_copy", F.explode(copies))
    return spread.withColumns({"block": F.col("_copy.b"), "is_context": F.col("_copy.x")}).drop("_copy")


def slices_of(df: DataFrame, slices: int | None = None) -> int:
    """Number of value slices: four per shuffle partition, which is set with the data, and 64 at least."""
    return slices or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def value_slices(distinct: DataFrame, by: Sequence[str], value: str, slices: int) -> DataFrame:
    """Append ``slice``: position of the value among approximate quantile edges.

    The edges only balance the work; results do not depend on them.
    """
    points = [i / slices for i in range(1, slices)]
    edges = distinct.groupBy(*by).agg(F.percentile_approx(value, points, max(2000, 20 * slices)).alias("_edges"))
    if by:
        on = [F.col(f"d.{k}").eqNullSafe(F.col(f"e.{k}")) for k in by]
        joined = distinct.alias("d").join(edges.alias("e"), on).select("d.*", "e._edges")
    else:
        joined = distinct.withColumn("_edges", edges.scalar())
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return joined.withColumn("slice", below).drop("_edges")


def cumulative_by_value(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """One row per distinct value with its own totals and the running totals up to it.

    Equal values are summed first (map side), so a hot value is a single row.
    Columns: ``by``, the value, each total ``n`` and its running form ``cum_n``.
    """
    distinct = df.groupBy(*by, value).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    cut = value_slices(distinct, by, value, slices_of(df, slices))
    if descending:
        cut = cut.withColumn("slice", -F.col("slice"))
    order = [F.desc(value) if descending else F.asc(value)]
    return sliced_running(
        cut, by, "slice", order, sums={f"cum_{n}": F.col(n) for n in sums}
    ).drop("slice")


def exact_percentiles(
    df: DataFrame,
    value: str,
    points: Mapping[str, float],
    by: Sequence[str] = (),
    slices: int | None = None,
    also: Sequence[Column] = (),
) -> DataFrame:
    """Linear-interpolated percentiles per key, exact at any group size.

    Built on running counts, so no aggregation buffer holds a group's values.
    ``also`` are further aggregates over the same non-null rows.
    """
    present = df.filter(F.col(value).isNotNull())
    runs = cumulative_by_value(present, value, {"n": F.lit(1).cast("bigint")}, by, slices=slices)
    sizes = present.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"), *also)
    if by:
        on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by]
        runs = runs.alias("r").join(sizes.alias("s"), on).select("r.*", "s._size")
    else:
        runs = runs.withColumn("_size", sizes.select("_size").scalar())
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    aggs = []
    for name, p in points.items():
        k = (F.col("_size") - 1) * F.lit(float(p))
        lo, hi = F.floor(k), F.ceil(k)
        aggs += [
            F.max(F.when(lo.between(first, last), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(hi.between(first, last), F.col(value))).alias(f"_hi_{name}"),
            F.max(k - lo).alias(f"_w_{name}"),
        ]
    got = runs.groupBy(*by).agg(*aggs)
    out = got.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in points
        ],
    )
    if not also:
        return out
    rest = sizes.drop("_size")
    return rest.join(out, list(by)) if by else rest.join(out)
