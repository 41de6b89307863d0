"""Registry of named queries over the driver's tables, each with its SQL oracle.

A query is a callable ``(spark, sf_dir) -> DataFrame``.  Doubles are rounded at
the very end (``finish``) so that results of differently-ordered float sums
compare equal with the SQL side, which rounds the same columns explicitly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn

    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column to ``digits`` decimals (final projection only)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def load_all() -> None:
    """Import the catalog modules so that they register their queries."""
    from cohortlens.plans import catalog  # noqa: F401
