"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, rounded down.

    Doesn't depend on the session's time zone; earlier times are negative.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return ((micros - F.pmod(micros, F.lit(1_000_000))) / 1_000_000).cast("long")


def signed_log(x: Column) -> Column:
    """sign(x) * log1p(abs(x))."""
    return F.signum(x) * F.log1p(F.abs(x))


def signed_exp(x: Column) -> Column:
    """The inverse of `signed_log`."""
    return F.signum(x) * F.expm1(F.abs(x))


def in_window(t: Column, start: Column, length: Column | int) -> Column:
    """True if t is in (start, start + length]."""
    return (t > start) & (t <= start + length)


def trailing(t: Column, end: Column, length: Column | int, inclusive: bool = False) -> Column:
    """True if t is in (end - length, end), or up to end itself if inclusive."""
    return (t > end - length) & ((t <= end) if inclusive else (t < end))


def count_if(condition: Column) -> Column:
    """How many rows satisfy the condition, 0 where none does."""
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("long")


def uniform(seed: int, *keys: str | Column) -> Column:
    """A draw in [0, 1) that depends on the seed and the keys only.

    Unlike rand(), it survives repartitioning and retries.
    """
    bits = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys]), F.lit(1 << 52))
    return bits / F.lit(float(1 << 52))


def weekday(t: Column) -> Column:
    """Day of the week of a time in seconds; 1970-01-01 is day 4."""
    return F.pmod(F.floor(t / DAY) + 4, F.lit(7)).cast("int")


def month_bucket(t: Column) -> Column:
    """30-day bucket of the year, 0 to 11."""
    return F.pmod(F.floor(t / (30 * DAY)), F.lit(12)).cast("int")
