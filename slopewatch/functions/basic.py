"""Small numeric, date and lookup expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slopewatch.params import LEVELS, PARAMS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp01(x: Column | str) -> Column:
    """Limit to [0, 1]; a missing or NaN value counts as 0."""
    # the argument occurs once, so nested limits do not multiply the expression tree
    known = F.nanvl(F.coalesce(_c(x).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), known))


def saturated(x: Column | str, full: float) -> Column:
    """``x`` as a share of the value that counts as full."""
    return clamp01(_c(x) / F.lit(float(full))) if full > 0 else F.lit(0.0)


def logistic(z: Column) -> Column:
    """exp overflows to infinity, which gives the right limit of 0."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def lookup(table: Mapping[str, float | str], key: Column | str) -> Column:
    """Constant table lookup, null for an unknown key."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(key))


def level_of(score: Column | str, bounds: Sequence[float] = tuple(PARAMS["class_bounds"])) -> Column:
    """Five-class cut, lower bounds inclusive."""
    score = _c(score)
    out = F.when(score < bounds[0], LEVELS[0])
    for bound, label in zip(bounds[1:], LEVELS[1:4]):
        out = out.when(score < bound, label)
    return F.when(score.isNotNull(), out.otherwise(LEVELS[4]))


def rank_of(level: Column | str) -> Column:
    """Ordinal 0..4 of a level name."""
    return lookup({name: i for i, name in enumerate(LEVELS)}, level)


def at_least(level: Column | str, minimum: str) -> Column:
    return rank_of(level) >= F.lit(LEVELS.index(minimum))


def argmax_name(named: Mapping[str, Column]) -> Column:
    """Name of the largest value; the earlier name wins a tie."""
    best = reduce(lambda a, b: F.greatest(a, b), named.values())
    out = None
    for name, col in named.items():
        out = F.when(col == best, name) if out is None else out.when(col == best, name)
    return out


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zoned or naive (UTC) timestamp."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def epoch_h(ts: Column | str) -> Column:
    return epoch_us(ts) / F.lit(3_600_000_000.0)


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(3_600_000_000.0)


def floor_to(ts: Column | str, unit: str) -> Column:
    return F.date_trunc(unit, _c(ts))


def build_id(ts: Column | str) -> Column:
    """Archive key of a valuation time, minute precision."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HHmm'Z'")


def pseudo_offset_days(key: Column | str, span_days: int = 3650) -> Column:
    """Stable day offset of a key: leading 32 bits of its sha-256, modulo the span."""
    head = F.conv(F.substring(F.sha2(_c(key).cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    return head % F.lit(span_days)


def spatial_block(lon: Column | str, lat: Column | str, edge: float = 0.5) -> Column:
    """Cross-validation block of a coordinate."""
    return F.concat_ws(
        "|", F.floor(_c(lon) / edge).cast("string"), F.floor(_c(lat) / edge).cast("string")
    )


def calibrated(value: Column, calibration: Column, prop: Column) -> Column:
    """``value * scale + offset`` with the identity where nothing is configured."""
    entry = F.try_element_at(calibration, prop)
    return value * F.coalesce(entry["scale"], F.lit(1.0)) + F.coalesce(entry["offset"], F.lit(0.0))


def horizon_hours(horizon: Column | str) -> Column:
    """Hours in a forecast tag such as ``+48h``."""
    return F.regexp_extract(_c(horizon), r"(\d+)", 1).cast("int")


def clamp_date(day: Column | str, today: Column) -> Column:
    return F.least(_c(day), today)
