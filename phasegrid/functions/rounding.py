"""Rounding of integer ratios exactly as correctly-rounded binary arithmetic does.

A ratio n/d rounded to a few decimals is ambiguous only on exact decimal ties.
There the binary double nearest to n/d decides: above the tie it goes up, below
it goes down, and when the tie is itself representable the even neighbour wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def round_ratio(num: Column, den: Column, digits: int = 2) -> Column:
    """num/den for non-negative integers, rounded to ``digits``; NULL when den = 0."""
    scale = 10**digits
    n, d = num.cast("long"), den.cast("long")
    doubled = n * F.lit(2 * scale)
    low = int_div(doubled, d * 2)
    is_tie = (doubled % (d * 2)) == d

    # distance of the double n/d from the tie, split so that every product is exact
    x = n.cast("double") / d
    grid = float(2**30)
    head = F.floor(x * grid).cast("double") / grid
    tie = (low * 2 + 1).cast("double")
    gap = (head * float(2 * scale) - tie) + (x - head) * float(2 * scale)
    on_tie = F.when(gap > 0, low + 1).when(gap < 0, low).otherwise(low + low % 2)

    units = F.when(is_tie, on_tie).otherwise(int_div(doubled + d, d * 2))
    return F.when(d > 0, units.cast("double") / float(scale))
