"""Averages and rounding that do not depend on how rows were partitioned."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_avg(col: Column | str, places: int, when: Column | None = None) -> Column:
    """Average of values with at most six decimals, summed exactly, rounded half to even."""
    c = F.col(col) if isinstance(col, str) else col
    c = c.cast("decimal(18,6)")
    if when is not None:
        c = F.when(when, c)
    return half_even(F.avg(c).cast("double"), places)


def exact_std(col: Column | str, places: int) -> Column:
    """Population standard deviation of values with at most six decimals, from exact integer sums, rounded half to even."""
    c = F.col(col) if isinstance(col, str) else col
    i = F.round(c * 1_000_000).cast("bigint")
    n, s1, s2 = F.count(c), F.sum(i), F.sum(i.cast("decimal(13,0)") * i.cast("decimal(13,0)"))
    spread = n.cast("decimal(12,0)") * s2.cast("decimal(25,0)") - s1.cast("decimal(18,0)") * s1.cast("decimal(18,0)")
    return half_even(F.sqrt(spread.cast("double")) / n / 1_000_000.0, places)


def half_even(x: Column | str, places: int) -> Column:
    """Round half to even on the exact binary value of a double, as long as x * 10^places stays below 2^52.

    The product x * 10^places is taken with its rounding error (x is split in two halves whose products
    are exact), so a tie is told apart from a value that only looks like one.
    """
    c = F.col(x) if isinstance(x, str) else x
    k = F.lit(float(10**places))
    p = c * k
    split = c * F.lit(134217729.0)
    high = split - (split - c)
    err = (high * k - p) + (c - high) * k
    low = F.floor(p)
    d = p - low
    up = (d > 0.5) | ((d == 0.5) & ((err > 0) | ((err == 0) & (low % 2 != 0))))
    return F.when(c.isNotNull(), (low + up.cast("int")) / k)
