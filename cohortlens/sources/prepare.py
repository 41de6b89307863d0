"""Input preparation: default fills (S8) and id normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import materialize


def default_fill(df: DataFrame, defaults: Mapping[str, object], fill_nulls: bool = False) -> DataFrame:
    """Add each absent column as a typed literal; with ``fill_nulls`` also
    coalesce nulls of present ones."""
    have = set(df.columns)
    add = {c: F.lit(v).cast("double") if isinstance(v, (int, float)) else F.lit(v) for c, v in defaults.items() if c not in have}
    out = df.withColumns(add) if add else df
    if fill_nulls:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in have})
    return out


def ranged(df: DataFrame, order: Sequence) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order`` and stored, with the range
    and the place in it as columns (``_range``, ``_place``).

    Both are data from here on: whatever reads them -- pruned to other columns,
    coalesced, run again after a lost executor -- sees the same ranges.  (Two
    branches that each range-partition the frame do not: the bounds are sampled
    per exchange.)

    Rows of equal ``order`` are spread by a hash of the whole row, and rows that
    are equal altogether by their place in the input, so that a key of a third of
    all rows is divided among as many ranges as its share asks for.
    """
    mid = F.monotonically_increasing_id()
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    row = df.withColumns({"_row_hash": F.xxhash64(*hashed) if hashed else F.lit(0), "_row_no": mid})
    keys = [*order, "_row_hash", "_row_no"]
    s = row.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row_hash", "_row_no")
    place = mid.bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(s.select("*", F.shiftright(mid, 33).alias("_range"), place.alias("_place")))


def range_offsets(per_range: DataFrame, sums: Mapping[str, str]) -> DataFrame:
    """``_range`` and, per entry ``column -> name``, the sum of ``column`` over
    all earlier ranges.  ``per_range`` has one row per range, so the global
    window is over as many rows as the sort had partitions."""
    prev = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select("_range", *[F.coalesce(F.sum(c).over(prev), F.lit(0)).alias(n) for c, n in sums.items()])


def row_positions(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """1-based global row number by ``order`` (which must be unique), without a
    single-partition window: the place of a row in its range plus the sizes of
    the ranges before it."""
    s = ranged(df, order)
    sizes = s.groupBy("_range").agg((F.max("_place") + 1).alias("_n"))
    j = s.join(F.broadcast(range_offsets(sizes, {"_n": "_off"})), "_range")  # one row per range
    return j.withColumn(out, F.col("_off") + F.col("_place") + 1).drop("_range", "_place", "_off")


def normalise_ids(df: DataFrame, id_col: str, order: Sequence[str], out: str | None = None) -> DataFrame:
    """Numeric id by ``try_cast``; rows whose id does not parse get their
    1-based position in ``order`` (the positional fill of the dashboards)."""
    out = out or id_col
    pos = row_positions(df, order, "_pos")
    parsed = F.col(id_col).cast("string").try_cast("bigint")
    return pos.withColumn(out, F.coalesce(parsed, F.col("_pos"))).drop("_pos")


def running_sums(df: DataFrame, order: Sequence, cols: Sequence[str], prefix: str = "cum_", inclusive: bool = True) -> DataFrame:
    """Global running sums of ``cols`` in ``order`` (Column sort orders allowed)
    without a single-partition window: running sums inside each range of the
    order, plus the totals of all earlier ranges."""
    s = ranged(df, order)
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    w = Window.partitionBy("_range").orderBy("_place").rowsBetween(*frame)
    local = s.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_loc_{c}") for c in cols])
    totals = s.groupBy("_range").agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols])
    offsets = range_offsets(totals, {f"_tot_{c}": f"_off_{c}" for c in cols})
    j = local.join(F.broadcast(offsets), "_range")  # one row per range
    return j.select(*df.columns, *[(F.col(f"_off_{c}") + F.col(f"_loc_{c}")).alias(f"{prefix}{c}") for c in cols])
