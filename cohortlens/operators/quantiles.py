"""Exact quantiles (linear interpolation, pandas / ``quantile_cont`` semantics)
by selection, without a global sort and without collecting a group's values.

Spark's ``percentile`` keeps a map of every distinct value of a group in one
aggregation buffer, and sorting a 100 TB column for a few ranks moves all of it.
Selection reads the data twice and moves next to nothing:

1. a mergeable sketch (``percentile_approx``) gives each group's size and a grid of
   approximate quantiles; each wanted rank lies between two of its lines;
2. one hash aggregate counts the rows between those brackets and, inside them,
   the rows of each distinct value.  Equal values are one row whatever their
   number, and both steps combine map-side.

Running counts over that small table give every wanted rank exactly.  A group
that keeps more than ``KEPT_VALUES`` distinct values is narrowed first by finer
grids over the kept values, as often as needed.  A rank that a sketch missed
(its error bound says none) would show, and the brackets are widened.

``approx=True`` switches to ``percentile_approx`` (bounded-memory sketch) for
callers that accept its error.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.sizing import broadcast_if_small, one_row
from cohortlens.session import materialize

#: Groups whose brackets (two doubles a rank) are broadcast to the rows.
SMALL_GROUPS = 50_000
#: Lines of the sketched grid, its accuracy (error 1/accuracy, an eighth of a cell), distinct values a group keeps at most, lines of finer grids.
GRID, ACCURACY, KEPT_VALUES, FINER = 512, 4096, 100_000, 64


def _sketch(df: DataFrame, value: str, groups: list[str], extra: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The non-null values (``_v``), and per group its size, grid and the extra
    aggregates.  Null group keys are dropped, as in a pandas groupby."""
    d = df.select(*groups, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    for g in groups:
        d = d.where(F.col(g).isNotNull())
    grid = F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], ACCURACY)
    aggs = [F.count(F.lit(1)).alias("_n"), grid.alias("_grid"), *[e.alias(k) for k, e in extra.items()]]
    return d, materialize(d.groupBy(*groups).agg(*aggs).where("_n > 0"))


def _brackets(sketch: DataFrame, groups: list[str], ranks: list[tuple[Column, Column]], margin: int) -> DataFrame:
    """Per group and wanted pair of ranks the values ``_lo<i>``, ``_hi<i>`` between
    which they lie, ascending; a null ``_hi`` is open."""

    def line(rank: Column, step: int) -> Column:
        return F.floor(rank * GRID / F.col("_n")).cast("int") + step

    def bracket(lo: Column, hi: Column) -> Column:
        a, b = line(lo, -margin), line(hi, 1 + margin)
        low = F.when(a <= 0, F.lit(float("-inf"))).otherwise(F.get("_grid", F.greatest(a, F.lit(0))))
        high = F.when(b < GRID, F.get("_grid", F.least(b, F.lit(GRID))))
        # nulls sort first, so an open end is flagged to come last
        return F.struct(low.alias("lo"), high.isNull().alias("open"), high.alias("hi"))

    sorted_ = sketch.select(*groups, F.array_sort(F.array(*[bracket(lo, hi) for lo, hi in ranks])).alias("_b"))
    columns = [F.col("_b")[i][s].alias(f"_{s}{i}") for i in range(len(ranks)) for s in ("lo", "hi")]
    return sorted_.select(*groups, *columns)


def _counts(d: DataFrame, groups: list[str], brackets: DataFrame, parts: int, few: bool) -> DataFrame:
    """``groups..., _slot, _v, _c``: rows by the number of brackets that begin at
    or below the value, and by the value itself inside the last of these (null:
    beyond it).  In order of (_slot, _v, nulls last) the values ascend.

    With ``few`` groups (counted, as the optimizer's estimate of an aggregate is
    that of its input) the brackets go to the rows: a shuffle by a handful of
    groups would put all rows into as many tasks."""
    j = d.join(F.broadcast(brackets) if few else brackets, groups) if groups else d.crossJoin(one_row(brackets))
    slot = sum(((F.col("_v") >= F.col(f"_lo{i}")).cast("int") for i in range(parts)), F.lit(0))
    high = F.get(F.array(*[F.col(f"_hi{i}") for i in range(parts)]), F.col("_slot") - 1)
    inside = F.when((F.col("_slot") > 0) & (high.isNull() | (F.col("_v") <= high)), F.col("_v"))
    cut = j.withColumn("_slot", slot).select(*groups, F.col("_slot").cast("bigint").alias("_slot"), inside.alias("_v"))
    return materialize(cut.groupBy(*groups, "_slot", "_v").agg(F.count(F.lit(1)).alias("_c")))


def _wanted(counts: DataFrame, groups: list[str], rank_of: Callable[[], list[tuple[Column, Column]]]) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """``counts`` with the group's size ``_n`` and the rows ``_before``, and for each
    wanted pair whether its ranks fall on the row."""
    all_ = Window.partitionBy(*groups)
    order = all_.orderBy("_slot", F.asc_nulls_last("_v")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({"_n": F.sum("_c").over(all_), "_before": F.coalesce(F.sum("_c").over(order), F.lit(0))})
    end = F.col("_before") + F.col("_c")
    return placed, [tuple((F.col("_before") <= r) & (r < end) for r in pair) for pair in rank_of()]


def _narrowed(counts: DataFrame, groups: list[str], rank_of: Callable) -> DataFrame:
    """``counts`` with finer slots, of which only those that hold a wanted rank
    keep their values."""
    inside = counts.where("_v IS NOT NULL")
    grid = F.percentile_approx("_v", [i / FINER for i in range(FINER + 1)], 8 * FINER).alias("_grid")
    grids = inside.groupBy(*groups, "_slot").agg(grid)
    on = [*groups, "_slot"]
    cell = F.size(F.filter("_grid", lambda x: x <= F.col("_v")))
    fine = inside.join(broadcast_if_small(grids), on).withColumn("_cell", cell).drop("_grid")
    fine = fine.unionByName(counts.where("_v IS NULL").withColumn("_cell", F.lit(FINER + 2)))
    fine = materialize(fine.withColumn("_slot", F.col("_slot") * (FINER + 3) + F.col("_cell")).drop("_cell"))
    cells = fine.groupBy(*groups, "_slot").agg(F.sum("_c").alias("_c"), F.count("_v").alias("_values"))
    placed, falls = _wanted(cells.withColumn("_v", F.lit(None).cast("double")), groups, rank_of)
    # a pair that straddles two cells needs both
    needed = F.lit(False)
    for a, b in falls:
        needed = needed | a | b
    keep = placed.select(*groups, "_slot", (needed & (F.col("_values") > 0)).alias("_keep"))
    marked = fine.join(keep, on)
    return materialize(marked.groupBy(*groups, "_slot", F.when(F.col("_keep"), F.col("_v")).alias("_v")).agg(F.sum("_c").alias("_c")))


def _select(
    df: DataFrame, value: str, groups: list[str], rank_of: Callable[[], list[tuple[Column, Column]]], extra: Mapping[str, Column], margin: int = 1
) -> DataFrame:
    """``groups..., _n, _x<i>, _y<i>`` and the extra aggregates: the values at the
    two ranks of each pair that ``rank_of`` makes of the column ``_n``."""
    d, sketch = _sketch(df, value, groups, extra)
    pairs = len(rank_of())
    few = sketch.count() <= SMALL_GROUPS
    while True:
        counts = _counts(d, groups, _brackets(sketch, groups, rank_of(), margin), pairs, few)
        while (counts.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0) > KEPT_VALUES:
            before = counts.count()
            counts = _narrowed(counts, groups, rank_of)
            if counts.count() >= before:
                break
        placed, falls = _wanted(counts, groups, rank_of)
        picks, missed = [], F.lit(False)
        for i, (a, b) in enumerate(falls):
            missed = missed | ((a | b) & F.col("_v").isNull())
            picks += [F.max(F.when(a, F.col("_v"))).alias(f"_x{i}"), F.max(F.when(b, F.col("_v"))).alias(f"_y{i}")]
        out = materialize(placed.groupBy(*groups).agg(F.max("_n").alias("_n"), F.max(missed).alias("_missed"), *picks))
        if margin >= GRID or not out.where("_missed").limit(1).count():
            break
        margin *= 4
    out = out.drop("_missed")
    if not extra:
        return out
    more = sketch.select(*groups, *extra)
    return out.join(broadcast_if_small(more), groups) if groups else out.crossJoin(one_row(more))


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    groups: Sequence[str] = (),
    names: Sequence[str] | None = None,
    approx: bool = False,
    accuracy: int = 10000,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per group: ``groups..., <name_i>`` = the ``probs[i]`` quantile of
    the non-null values (groups with no value are absent; without groups one row
    of nulls if there is none).  ``extra`` names aggregates of the values (column
    ``_v``) that the sketch pass computes along the way; they come after the
    quantiles."""
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    groups, extra = list(groups), dict(extra or {})
    if approx:
        d = df.where(F.col(value).isNotNull())
        g = d.groupBy(*groups) if groups else d.groupBy()
        arr = g.agg(F.percentile_approx(F.col(value).cast("double"), list(probs), accuracy).alias("_q"))
        return arr.select(*groups, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])

    def place(p: float) -> Column:
        return (F.col("_n") - 1) * F.lit(float(p))

    def rank_of() -> list[tuple[Column, Column]]:
        return [(F.floor(place(p)).cast("bigint"), F.ceil(place(p)).cast("bigint")) for p in probs]

    got = _select(df, value, groups, rank_of, extra)
    x, y = (lambda i: F.col(f"_x{i}")), (lambda i: F.col(f"_y{i}"))
    cols = [(x(i) + (place(p) - F.floor(place(p))) * (y(i) - x(i))).alias(n) for i, (p, n) in enumerate(zip(probs, names, strict=True))]
    return _or_nulls(got.select(*groups, *cols, *extra), groups)


def order_statistics(df: DataFrame, value: str, ranks: Mapping[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Exact k-th smallest values: ``ranks`` maps an output name to a Column
    expression of ``_n`` (the group's count) giving a 0-based rank.  Same
    selection as ``quantiles``; one row per group."""
    groups = list(groups)

    def rank_of() -> list[tuple[Column, Column]]:
        return [(e.cast("bigint"), e.cast("bigint")) for e in ranks.values()]

    got = _select(df, value, groups, rank_of, {})
    return _or_nulls(got.select(*groups, *[F.col(f"_x{i}").alias(k) for i, k in enumerate(ranks)]), groups)


def _or_nulls(out: DataFrame, groups: list[str]) -> DataFrame:
    """Without groups, one row in any case."""
    if groups:
        return out
    return out.groupBy().agg(*[F.max(c).alias(c) for c in out.columns])
