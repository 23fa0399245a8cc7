"""Long constant arrays in a plan, and binary search in them, without an expression for each element."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrays up to so long are spelled out.
SHORT = 64


def literal_array(values: Sequence) -> Column:
    """A constant array. Long arrays of numbers go into the plan as one string, which the optimizer turns into the array once."""
    values = values.tolist() if isinstance(values, np.ndarray) else list(values)
    kinds = {type(v) for v in values}
    if len(values) <= SHORT or not kinds <= {int, float}:
        return F.array(*map(F.lit, values))
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<bigint>" if kinds == {int} else "array<double>")


def last_at_or_below(x: Column, breaks: Sequence) -> Column:
    """The place of the last of ascending ``breaks`` at or below ``x``; 0 if all are above it.

    A few breaks become a tree of comparisons, which is compiled; many a binary search, whose plan has one step for each doubling.
    """
    breaks = breaks.tolist() if isinstance(breaks, np.ndarray) else list(breaks)
    n = len(breaks)
    if n <= SHORT:

        def tree(low: int, high: int) -> Column:
            if high - low == 1:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(x < breaks[middle], tree(low, middle)).otherwise(tree(middle, high))

        return tree(0, n).cast("long")
    table = literal_array(breaks)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range((n - 1).bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < n) & (x >= F.get(table, at + step)), at + step).otherwise(at))
    return found.cast("long")
