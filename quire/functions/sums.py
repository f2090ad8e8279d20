"""Sums of doubles that don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 2**52


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of finite doubles below 2^53, to the last place but one, the same in any order and partitioning; null of none.

    Each value is parted into its floor and two integers of 52 bits, which hold its fraction down to 2^-104.  Those are added up as decimals, without loss,
    and put together once at the end.
    """
    whole = F.floor(value)
    part = (value - whole) * float(LIMB)
    high = F.floor(part)
    low = F.floor((part - high) * float(LIMB))
    a, h, b = (F.sum(x.cast("decimal(38,0)")) for x in (whole, high, low))
    limb = F.lit(LIMB).cast("decimal(38,0)")
    h = h + F.call_function("div", b, limb)
    a = a + F.call_function("div", h, limb)
    return a.cast("double") + ((h % limb).cast("double") + (b % limb).cast("double") / float(LIMB)) / float(LIMB)


def exact_avg(value: Column) -> Column:
    """Aggregate: exact_sum by the number of values."""
    return exact_sum(value) / F.count(value)
