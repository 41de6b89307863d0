"""Row-wise feature engineering over the wide table.

All columns are resolved from the schema on the driver, then added in a single
``withColumns`` projection of array-based row means (no per-column frames, no
left-deep sums).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import config
from cohortlens.functions.rowwise import row_mean, row_std, row_sum
from cohortlens.operators.reshape import parse_metric_name
from cohortlens.session import wide_plan_guard

TEXTBOOK_STAGE_NAMES = {
    "Lower_Primary": "Textbook_Access_1_4",
    "Upper_Primary": "Textbook_Access_5_8",
    "Secondary": "Textbook_Access_9_10",
    "Preparatory": "Textbook_Access_11_12",
}


def stage_columns(
    columns: Sequence[str],
    keyword: str,
    grades: Sequence[int],
    compat_prefix: bool = False,
) -> list[str]:
    """Columns of one metric keyword in the given grades.

    Default: the grade is parsed from the name (``Grade_1`` means grade 1 only).
    ``compat_prefix``: the notebooks' ``startswith('Grade_<g>')`` test, where
    ``Grade_1`` also matches ``Grade_10``-``Grade_12`` (quirk Q1); the keyword is
    a case-insensitive substring there as well."""
    out = []
    for c in columns:
        if compat_prefix:
            if any(c.startswith(f"Grade_{g}") for g in grades) and keyword.lower() in c.lower():
                out.append(c)
        else:
            p = parse_metric_name(c)
            if p and p[0] in set(grades) and p[2] == keyword:
                out.append(c)
    return sorted(set(out), key=columns.index)


def stage_averages(
    df: DataFrame,
    metrics: Mapping[str, str] = config.METRICS,
    stages: Mapping[str, tuple[int, int]] = config.STAGES,
    compat_prefix: bool = False,
    drop_source: bool = False,
) -> DataFrame:
    """H1: ``Avg_<metric>_<stage>`` = null-skipping row mean of the stage's columns."""
    wide_plan_guard(df.sparkSession)
    new: dict[str, Column] = {}
    used: set[str] = set()
    for keyword, short in metrics.items():
        kw = keyword if not compat_prefix else ("Participation" if short == "Participation" else keyword)
        for stage, (lo, hi) in stages.items():
            cols = stage_columns(df.columns, kw, range(lo, hi + 1), compat_prefix)
            used.update(cols)
            new[f"Avg_{short}_{stage}"] = row_mean([F.col(f"`{c}`") for c in cols])
    out = df.withColumns(new)
    return out.drop(*used) if drop_source else out


def textbook_access(
    df: DataFrame,
    stages: Mapping[str, tuple[int, int]] = config.STAGES,
    compat_prefix: bool = False,
) -> DataFrame:
    """H2: share of Yes per stage (Yes -> 1, No -> 0, anything else null, skipped);
    a stage with no textbook column is 0."""
    new = {}
    for stage, (lo, hi) in stages.items():
        cols = stage_columns(df.columns, "Textbook", range(lo, hi + 1), compat_prefix)
        vals = [
            F.when(F.col(f"`{c}`") == "Yes", F.lit(1.0)).when(F.col(f"`{c}`") == "No", F.lit(0.0)) for c in cols
        ]
        new[TEXTBOOK_STAGE_NAMES.get(stage, f"Textbook_Access_{stage}")] = row_mean(vals) if cols else F.lit(0.0)
    return df.withColumns(new)


def overall_averages(df: DataFrame, stages: Sequence[str] = tuple(config.STAGES)) -> DataFrame:
    """H4: overall = unweighted null-skipping mean of the stage means."""
    new = {
        "Overall_Avg_Attendance": row_mean([f"Avg_Attendance_{s}" for s in stages]),
        "Overall_Avg_Homework": row_mean([f"Avg_HW_Completion_{s}" for s in stages]),
        "Overall_Avg_Participation": row_mean([f"Avg_Participation_{s}" for s in stages]),
        "Overall_Test_Score_Avg": row_mean([f"Avg_Test_Score_{s}" for s in stages]),
    }
    tb = [c for c in TEXTBOOK_STAGE_NAMES.values() if c in df.columns]
    if tb:
        new["Overall_Textbook_Access_Composite"] = row_mean(tb)
    return df.withColumns(new)


def engagement_weighted(
    df: DataFrame,
    cols: Sequence[str] = ("Overall_Avg_Attendance", "Overall_Avg_Homework", "Overall_Avg_Participation"),
    weights: Sequence[float] = config.ENGAGEMENT_WEIGHTS,
    out: str = "Overall_Engagement_Score",
) -> DataFrame:
    """H5: weighted sum (null if any input is null)."""
    expr = None
    for c, w in zip(cols, weights):
        term = F.col(c) * F.lit(w)
        expr = term if expr is None else expr + term
    return df.withColumn(out, expr)


def growth_and_consistency(df: DataFrame, stages: Sequence[str] = tuple(config.STAGES)) -> DataFrame:
    """H7 growth = Secondary - Lower_Primary test score;
    H8 consistency = row sample std over the attendance stage means and the
    overall attendance (the columns that still contain 'Attendance' when the
    notebooks compute it)."""
    att = [f"Avg_Attendance_{s}" for s in stages] + ["Overall_Avg_Attendance"]
    return df.withColumns(
        {
            "Academic_Growth_Primary_to_Secondary": F.col("Avg_Test_Score_Secondary") - F.col("Avg_Test_Score_Lower_Primary"),
            "Attendance_Consistency": row_std(att),
        }
    )


def track_averages(
    df: DataFrame,
    tracks: Mapping[str, Sequence[str]],
    field_col: str,
    first_track_value=0,
    first: str = "Social",
    second: str = "Natural",
    common: str = "Common",
) -> DataFrame:
    """H3: per-track subject means, the student's track mean chosen by the field
    flag (``field == first_track_value`` -> first track), the common mean, and
    ``Track_Exam_Average = (common + track) / 2``."""
    out = df.withColumns(
        {
            f"{first}_Track_Subject_Avg": row_mean(list(tracks[first])),
            f"{second}_Track_Subject_Avg": row_mean(list(tracks[second])),
            "Common_Exam_Average": row_mean(list(tracks[common])),
        }
    )
    out = out.withColumn(
        "Track_Subject_Average",
        F.when(F.col(field_col) == F.lit(first_track_value), F.col(f"{first}_Track_Subject_Avg")).otherwise(
            F.col(f"{second}_Track_Subject_Avg")
        ),
    )
    return out.withColumn("Track_Exam_Average", (F.col("Common_Exam_Average") + F.col("Track_Subject_Average")) / 2)


def total_of(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """H9: sum of the available columns, nulls as 0."""
    return df.withColumn(out, row_sum(list(cols), nulls_as_zero=True))


def age_parts(
    df: DataFrame,
    dob_col: str,
    reference_date: str = config.REFERENCE_DATE,
    default_age: int | None = None,
) -> DataFrame:
    """``floor(days(reference - dob) / 365)`` (365-day years, quirk
    Q17) and birth year / month / day; an unparsable date gives null (or
    ``default_age`` in serving)."""
    dob = F.col(dob_col).cast("string").try_cast("date") if dict(df.dtypes)[dob_col] == "string" else F.col(dob_col).cast("date")
    age = F.floor(F.datediff(F.lit(reference_date).cast("date"), dob) / 365).cast("double")
    if default_age is not None:
        age = F.coalesce(age, F.lit(float(default_age)))
    return df.withColumns(
        {"Age": age, "Birth_Year": F.year(dob), "Birth_Month": F.month(dob), "Birth_Day": F.dayofmonth(dob)}
    )
