"""Row-wise (horizontal) aggregates over a list of columns.

Nulls are skipped (pandas ``mean(axis=1)`` semantics); an all-null row gives
null.  Each column is referenced exactly once, inside one ``array``, which is
folded with ``aggregate`` left to right (the order pandas / SQL use).  Two
properties matter at width: a left-deep ``c1 + c2 + ...`` over hundreds of
columns overflows the JVM stack, and expressions that mention a column several
times (sum and count, mean inside a deviation) multiply when Catalyst inlines
nested row statistics -- the plan size must stay linear in the columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _arr(cols: Sequence[str | Column]) -> Column:
    return F.array_compact(
        F.array(*[(F.col(f"`{c}`") if isinstance(c, str) else c).cast("double") for c in cols])
    )


def row_count(cols: Sequence[str | Column]) -> Column:
    """Number of non-null values in the row."""
    if not cols:
        return F.lit(0)
    return F.size(_arr(cols))


def row_sum(cols: Sequence[str | Column], nulls_as_zero: bool = True) -> Column:
    """Sum of the non-null values; with ``nulls_as_zero`` an all-null row is 0."""
    if not cols:
        return F.lit(0.0) if nulls_as_zero else F.lit(None).cast("double")
    arr = _arr(cols)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return total if nulls_as_zero else F.when(F.size(arr) > 0, total)


def row_mean(cols: Sequence[str | Column]) -> Column:
    """Mean of the non-null values; null when every value is null."""
    if not cols:
        return F.lit(None).cast("double")
    return F.aggregate(
        _arr(cols),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["n"] + 1).alias("n")),
        lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]),
    )


def row_std(cols: Sequence[str | Column]) -> Column:
    """Sample standard deviation (ddof=1) of the non-null values; null when n < 2
    (two passes over the row's array: mean, then squared deviations)."""
    if not cols:
        return F.lit(None).cast("double")
    arr = _arr(cols)
    n = F.size(arr)
    mean = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / n
    ss = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(ss / (n - 1)))
