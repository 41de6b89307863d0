"""Entry point A: the wide table to a star schema for BI (one lazy DAG, one write
per table).  Built here on the fixture analogues (customer = entity, supplier =
school, lineitem months = grades)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import config
from cohortlens.functions.categorize import subject_category, tier_bin
from cohortlens.operators import clean, report
from cohortlens.operators import reshape as rs
from cohortlens.operators.sizing import broadcast_if_small
from cohortlens.plans import fixtures as fx
from cohortlens.session import scratch_path
from cohortlens.sources.io import write_tables
from cohortlens.sources.tables import load

SCORE = "score"  # c_acctbal / 100: mostly 0-100, negatives fall out of the range filter


def grade_dim(spark: SparkSession) -> DataFrame:
    """12 rows: grade, cycle (fours), stage (1-8 / 9-12)."""
    g = spark.range(1, 13).select(F.col("id").cast("int").alias("Grade_Level"))
    cyc = None
    for name, (lo, hi) in config.GRADE_CYCLES.items():
        c = F.col("Grade_Level").between(lo, hi)
        cyc = F.when(c, F.lit(name)) if cyc is None else cyc.when(c, F.lit(name))
    stg = None
    for name, (lo, hi) in config.GRADE_STAGES.items():
        c = F.col("Grade_Level").between(lo, hi)
        stg = F.when(c, F.lit(name)) if stg is None else stg.when(c, F.lit(name))
    return g.select("Grade_Level", cyc.alias("Cycle"), stg.alias("Stage"))


def behaviour_fact(cells_df: DataFrame) -> DataFrame:
    """The long fact straight from the per-cell aggregate: what the wide pivot and
    its unpivot give, without going through hundreds of columns."""
    metrics = F.array(*[F.struct(F.lit(m).alias("Metric"), F.col(m).alias("Value")) for m in rs.NUMERIC_METRICS])
    long = cells_df.select(
        F.col("cid").alias("c_custkey"),
        F.col("grade").cast("int").alias("Grade_Level"),
        F.regexp_replace("subject", "_", " ").alias("Subject"),
        F.explode(metrics).alias("_m"),
    ).select("c_custkey", "Grade_Level", "Subject", "_m.Metric", "_m.Value")
    long = long.where(F.col("Value").between(0.0, 100.0))
    return long.withColumn("Category", subject_category("Subject"))


def summary(students: DataFrame, key: str) -> DataFrame:
    return report.group_count_mean(students, key, SCORE, "c_custkey")


def star_tables(spark: SparkSession, sf: str, behaviour: DataFrame, textbook: DataFrame, exams: DataFrame) -> dict[str, DataFrame]:
    """All tables of the schema from the stored facts."""
    people = fx.people(spark, sf).withColumn(SCORE, F.col("c_acctbal") / 100)
    students = clean.dedupe_first(people, ["c_custkey"], ["c_name"])
    students = clean.in_range(students, SCORE, 0, 100).withColumn("Performance_Tier", tier_bin(SCORE))
    schools = clean.dedupe_first(load(spark, sf, "supplier"), ["s_suppkey"], ["s_name"])
    tests = behaviour.where(F.col("Metric") == "Test_Score")
    academic = report.per_key_mean(tests, "c_custkey", "Value", "Academic_Avg")
    pairs = behaviour.where(F.col("Metric").isin("Attendance", "Test_Score"))
    by_school = report.group_count_mean(load(spark, sf, "lineitem"), "l_suppkey", "l_quantity")
    names = schools.select("s_suppkey", "s_name", "s_nationkey")
    by_school = by_school.join(broadcast_if_small(names), by_school.l_suppkey == F.col("s_suppkey"), "left").drop("s_suppkey")
    rows = F.count(F.lit(1))
    passed = F.coalesce(F.col(SCORE) >= config.PASS_MARK, F.lit(False)).cast("int")
    quality = report.quality_report(
        [
            ("Students", students, rows),
            ("Schools", schools, rows),
            ("Behavior Rows", behaviour, rows),
            ("National Rows", exams, rows),
            ("Textbook Rows", textbook, rows),
            ("Avg Score", students, F.round(F.avg(SCORE), 2)),
            ("Pass Rate", students, F.round(100 * F.avg(passed), 2)),
            ("Test Score Records", tests, rows),
        ]
    )
    return {
        "00_quality_report": quality,
        "01_students": students.join(academic, "c_custkey", "left"),
        "02_schools": schools,
        "03_grades": grade_dim(spark),
        "04_behavior": behaviour,
        "05_subject_performance": report.group_stats(tests, ["Grade_Level", "Subject", "Category"], "Value"),
        "06_national_exams": exams,
        "07_region": summary(students, "r_name"),
        "08_segment": summary(students, "c_mktsegment"),
        "09_nation": summary(students, "n_name"),
        "10_textbook": textbook,
        "11_attendance_correlation": rs.long_to_wide(
            pairs, ["c_custkey", "Grade_Level", "Subject"], "Metric", ["Attendance", "Test_Score"], "Value"
        ),
        "12_school_performance": by_school,
    }


def write_star_schema(spark: SparkSession, sf: str, base: str, fmt: str = "parquet") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Write every table under ``base``; the manifest and the frames written.

    The cell aggregate and the three facts that others are made of are stored in
    the scratch folder first, outside what is delivered, whatever the format of
    the delivery: no pivot is computed twice, and lost executors cost no more
    than their own tasks."""
    held = scratch_path(spark, f"star-facts/{uuid.uuid4().hex}")

    def store(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(os.path.join(held, name))
        return spark.read.schema(df.schema).parquet(os.path.join(held, name))

    cells = store("cells", fx.cells(spark, sf))
    behaviour = store("behaviour", behaviour_fact(cells))
    textbook = store("textbook", rs.textbook_long(fx.customer_wide(spark, sf, ["Textbook"], cells), ["c_custkey"]))
    exams = store("exams", rs.exam_long(fx.exam_wide(spark, sf), ["user_id"], "Exam_"))
    tables = star_tables(spark, sf, behaviour, textbook, exams)
    return write_tables(spark, tables, base, fmt), tables
