"""Wide <-> long reshapes.

Metric column names ``Grade_<g>_<Subject>_<Metric>`` are metadata: they are
parsed once on the driver from the schema into a small name table (one row per
column), so no row runs a regex.  ``parse_name_col`` is the same grammar as a
Column expression for names that arrive as data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.categorize import yes_no_decode

# FIXED VALUES: the metric-name grammar
NUMERIC_METRICS = ("Test_Score", "Attendance", "Homework_Completion", "Class_Participation")
METRIC_NAME_RE = r"^Grade_(\d+)_(.+?)_(Test_Score|Attendance|Homework_Completion|Class_Participation|Textbook)$"
_NAME = re.compile(METRIC_NAME_RE)


def parse_metric_name(name: str) -> tuple[int, str, str] | None:
    """``Grade_10_Civics_and_Ethics_Test_Score`` -> (10, 'Civics and Ethics', 'Test_Score');
    names outside the grammar (``Grade_Level``) -> None."""
    m = _NAME.match(name)
    if not m:
        return None
    return int(m.group(1)), m.group(2).replace("_", " "), m.group(3)


def parse_name_col(c: Column | str) -> Column:
    """R1 as a Column: struct(grade INT, subject STRING, metric STRING), null fields when no match."""
    s = F.col(c) if isinstance(c, str) else c
    ok = s.rlike(METRIC_NAME_RE)
    return F.struct(
        F.when(ok, F.regexp_extract(s, METRIC_NAME_RE, 1).cast("int")).alias("grade"),
        F.when(ok, F.regexp_replace(F.regexp_extract(s, METRIC_NAME_RE, 2), "_", " ")).alias("subject"),
        F.when(ok, F.regexp_extract(s, METRIC_NAME_RE, 3)).alias("metric"),
    )


def metric_columns(columns: Sequence[str], metrics: Sequence[str] = NUMERIC_METRICS) -> list[tuple[str, int, str, str]]:
    """(column, grade, subject, metric) for every metric column of the schema."""
    out = []
    for c in columns:
        p = parse_metric_name(c)
        if p and p[2] in metrics:
            out.append((c, *p))
    return out


def wide_to_long(
    df: DataFrame,
    id_cols: Sequence[str],
    metrics: Sequence[str] = NUMERIC_METRICS,
    value_range: tuple[float, float] | None = (0.0, 100.0),
) -> DataFrame:
    """R2: every metric column as a row ``(ids..., Grade_Level, Subject, Metric,
    Value)``; text is coerced to double (unparsable -> null), nulls dropped, and
    values kept inside ``value_range`` (``None`` keeps all, as in the second ETL
    variant).

    The values are one array, exploded with their places: a single Generate in
    place of a projection per column.  The name parts come from a table of the
    schema (one row per metric column, so it is broadcast), joined by place after
    the filter."""
    cols = metric_columns(df.columns, metrics)
    types = dict(df.dtypes)
    vals = [
        F.col(f"`{c}`").cast("string").try_cast("double") if types[c] == "string" else F.col(f"`{c}`").cast("double") for c, *_ in cols
    ]
    long = df.select(*id_cols, F.posexplode(F.array(*vals) if vals else F.expr("cast(array() as array<double>)")).alias("_place", "Value"))
    long = long.where(F.col("Value").isNotNull())
    if value_range is not None:
        long = long.where(F.col("Value").between(*value_range))
    return long.join(F.broadcast(_name_table(df, cols)), "_place").select(*id_cols, "Grade_Level", "Subject", "Metric", "Value")


def _name_table(df: DataFrame, cols: Sequence[tuple[str, int, str, str]]) -> DataFrame:
    """The name parts of each metric column by its place among them."""
    return df.sparkSession.createDataFrame(
        [(i, g, s, m) for i, (_, g, s, m) in enumerate(cols)], "_place int, Grade_Level int, Subject string, Metric string"
    )


def textbook_long(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Textbook columns to ``(ids..., Grade_Level, Subject, Has_Textbook)``;
    the yes/no decode maps anything else, null included, to 0 (no row is dropped)."""
    cols = metric_columns(df.columns, ("Textbook",))
    flags = [yes_no_decode(F.col(f"`{c}`")) for c, *_ in cols]
    long = df.select(*id_cols, F.posexplode(F.array(*flags) if flags else F.expr("cast(array() as array<int>)")).alias("_place", "Has_Textbook"))
    return long.join(F.broadcast(_name_table(df, cols)), "_place").select(*id_cols, "Grade_Level", "Subject", "Has_Textbook")


def exam_long(df: DataFrame, id_cols: Sequence[str], prefix: str) -> DataFrame:
    """``<prefix><Subject>`` columns to ``(ids..., Subject, Score)``; prefix
    stripped, coerced to double, nulls dropped."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    packed = [
        F.struct(
            F.lit(c[len(prefix):]).alias("Subject"),
            F.col(f"`{c}`").cast("string").try_cast("double").alias("Score"),
        ).alias(c)
        for c in cols
    ]
    out = df.select(*id_cols, *packed).unpivot(list(id_cols), cols, "_variable", "_cell").select(*id_cols, "_cell.*")
    return out.where(F.col("Score").isNotNull())


def long_to_wide(
    long: DataFrame,
    keys: Sequence[str],
    pivot_col: str,
    values: Sequence[str],
    value_col: str,
) -> DataFrame:
    """``groupBy(keys).pivot(pivot_col, values).agg(avg(value_col))``; the
    explicit value list avoids the extra distinct pass."""
    return long.groupBy(*keys).pivot(pivot_col, list(values)).agg(F.avg(value_col))


def stat_table(df: DataFrame, columns: Sequence[str], stats: dict[str, callable]) -> DataFrame:
    """One global aggregate of ``stat(col)`` for every (feature, stat) pair,
    returned long as ``(feature, stat, value)``; pivot on demand."""
    exprs = [fn(F.col(c)).cast("double").alias(f"{c}__{s}") for c in columns for s, fn in stats.items()]
    row = df.agg(*exprs)
    cells = [
        F.struct(F.lit(c).alias("feature"), F.lit(s).alias("stat"), F.col(f"{c}__{s}").alias("value"))
        for c in columns
        for s in stats
    ]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Vertical concat by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
