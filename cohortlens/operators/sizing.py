"""Size-checked broadcast.

``broadcast()`` is only safe when the side is provably small.  The optimizer's
size estimate of a plan (file sizes of the scans, multiplied through the plan) is
available without running anything; a side is broadcast only when that estimate
is below the limit, otherwise the join is left to the planner (sort-merge, or an
AQE broadcast after the side was actually measured at runtime).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - Spark Connect has no JVM handle
        return None


def broadcast_if_small(df: DataFrame, limit_bytes: int = DEFAULT_LIMIT) -> DataFrame:
    """Hint a broadcast only when the plan's size estimate is within ``limit_bytes``."""
    size = estimated_bytes(df)
    if size is not None and size <= limit_bytes:
        return F.broadcast(df)
    return df


def one_row(df: DataFrame) -> DataFrame:
    """Broadcast a global aggregate (exactly one row by construction)."""
    return F.broadcast(df)
