"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Keep the wanted columns that exist, in the wanted order (duplicates once, P3)."""
    have = set(df.columns)
    return df.select(*unique_names([c for c in wanted if c in have]))


def unique_names(names: Iterable[str]) -> list[str]:
    """First occurrence of each name, order kept."""
    seen: set[str] = set()
    out = []
    for n in names:
        if n not in seen:
            seen.add(n)
            out.append(n)
    return out


def drop_columns(
    df: DataFrame,
    names: Sequence[str] = (),
    prefixes: Sequence[str] = (),
    contains_ci: Sequence[str] = (),
) -> DataFrame:
    """Drop listed names, names with a prefix, and names containing a
    case-insensitive token.  Resolved on the driver from the schema only."""
    low = [t.lower() for t in contains_ci]
    drop = [
        c
        for c in df.columns
        if c in set(names) or any(c.startswith(p) for p in prefixes) or any(t in c.lower() for t in low)
    ]
    return df.drop(*drop)


def in_range(df: DataFrame, col: str, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Inclusive range filter (null is dropped, as in pandas ``between``)."""
    return df.where(F.col(col).between(lo, hi))


def drop_nulls(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """P5."""
    return df.dropna(subset=list(subset))


def filter_rows(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    ranges: Mapping[str, tuple[float, float]] | None = None,
    all_token: str = "All",
) -> DataFrame:
    """Conjunction of equality filters (``All`` disables one) and inclusive ranges."""
    cond: Column = F.lit(True)
    for col, val in (equals or {}).items():
        if val is None or val == all_token:
            continue
        cond = cond & (F.col(col) == F.lit(val))
    for col, (lo, hi) in (ranges or {}).items():
        cond = cond & F.col(col).between(lo, hi)
    return df.where(cond)


def like_escape(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def id_search(df: DataFrame, col: str, term: str) -> DataFrame:
    """Case-insensitive substring search on the id rendered as text.  The term
    is matched literally (LIKE wildcards escaped)."""
    return df.where(F.col(col).cast("string").ilike(f"%{like_escape(term)}%"))


def point_lookup(df: DataFrame, col: str, value) -> DataFrame:
    """P8."""
    return df.where(F.col(col) == F.lit(value))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """P10: one row per key, the first by ascending ``order`` (remaining columns
    break any tie, so the result is deterministic).

    Expressed as ``min(struct(order..., rest...))`` per key rather than a
    ``row_number`` window: the aggregate combines map-side, so a key holding a
    third of all rows leaves each task as one row instead of one sorted group."""
    rest = [c for c in df.columns if c not in set(keys)]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])
    agg = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return agg.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Full-row (or subset) duplicates with their multiplicity."""
    cols = list(cols or df.columns)
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_copies")).where(F.col("n_copies") > 1)


def flag_below(col: Column | str, mark: float) -> Column:
    """``(col < mark)`` as 0/1; null -> null."""
    c = F.col(col) if isinstance(col, str) else col
    return (c < F.lit(mark)).cast("int")


def flag_at_least(col: Column | str, mark: float) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return (c >= F.lit(mark)).cast("int")
