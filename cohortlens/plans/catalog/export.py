"""Source / sink queries (S1, S3-S5): every write goes under the cluster's
``spark.checkpoint.dir`` and is read back, so the result shows what was stored."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortlens import config
from cohortlens.plans import fixtures as fx
from cohortlens.plans.catalog.core import behaviour_long_sql
from cohortlens.plans.registry import finish, register
from cohortlens.plans.star_schema import write_star_schema
from cohortlens.session import scratch_path
from cohortlens.sources import io
from cohortlens.sources.tables import load

_EXPORT_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "no_such_column"]
_EXPORT_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"


@register(
    "csv_roundtrip",
    sql="SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders",
)
def csv_roundtrip(spark, sf):
    """S5 export of the selected columns to CSV (stored row count reported, S3),
    then S1 scan back with an explicit schema."""
    path = scratch_path(spark, f"export/orders_{uuid.uuid4().hex}")
    io.export_selected(load(spark, sf, "orders"), _EXPORT_COLS, path, "csv")
    return io.read_csv(spark, path, _EXPORT_SCHEMA)


_STAR_CTES = (
    fx.with_ctes(behaviour_long_sql(), fx.PEOPLE_SQL, fx.EXAM_WIDE_SQL)
    + """, st AS (SELECT p.*, c_acctbal / 100 AS score, CASE WHEN c_acctbal / 100 > 0 AND c_acctbal / 100 <= 50 THEN 'Critical'
    WHEN c_acctbal / 100 > 50 AND c_acctbal / 100 <= 70 THEN 'Needs Improvement'
    WHEN c_acctbal / 100 > 70 AND c_acctbal / 100 <= 85 THEN 'Satisfactory'
    WHEN c_acctbal / 100 > 85 AND c_acctbal / 100 <= 100 THEN 'Excellent' END AS Performance_Tier
  FROM people p WHERE c_acctbal / 100 BETWEEN 0 AND 100),
tests AS (SELECT * FROM behaviour_long WHERE Metric = 'Test_Score'),
academic AS (SELECT c_custkey, avg(Value) AS Academic_Avg FROM tests GROUP BY c_custkey),
exams AS (SELECT user_id, replace(variable, 'Exam_', '') AS Subject, CAST(value AS DOUBLE) AS Score FROM (
  UNPIVOT exam_wide ON COLUMNS('^Exam_') INTO NAME variable VALUE value) WHERE value IS NOT NULL),
textbook AS (SELECT c_custkey, g.grade::INT AS Grade_Level, replace(s.subject, '_', ' ') AS Subject, (x.Textbook IS NOT DISTINCT FROM 'Yes')::INT AS Has_Textbook
  FROM customer CROSS JOIN range(1, 13) AS g(grade) CROSS JOIN (SELECT unnest(["""
    + ", ".join(f"'{v}'" for v in fx.FLAG_STATUS)
    + """]) AS subject) s
  LEFT JOIN cells x ON x.cid = c_custkey AND x.grade = g.grade AND x.subject = s.subject)"""
)
_STAGES = " ".join(f"WHEN g BETWEEN {lo} AND {hi} THEN '{n}'" for n, (lo, hi) in config.GRADE_STAGES.items())
_CYCLES = " ".join(f"WHEN g BETWEEN {lo} AND {hi} THEN '{n}'" for n, (lo, hi) in config.GRADE_CYCLES.items())
#: Each delivered table: its rows in SQL, its columns (fractional ones marked with *).
_STAR = {
    "00_quality_report": (
        f"""SELECT * FROM (VALUES ('Students', (SELECT count(*) FROM st)::DOUBLE), ('Schools', (SELECT count(DISTINCT s_suppkey) FROM supplier)),
  ('Behavior Rows', (SELECT count(*) FROM behaviour_long)), ('National Rows', (SELECT count(*) FROM exams)), ('Textbook Rows', (SELECT count(*) FROM textbook)),
  ('Avg Score', (SELECT round(avg(score), 2) FROM st)), ('Pass Rate', (SELECT round(100 * avg((score >= {config.PASS_MARK})::INT), 2) FROM st)),
  ('Test Score Records', (SELECT count(*) FROM tests))) AS q(metric, value)""",
        "metric value*",
    ),
    "01_students": (
        "SELECT st.*, Academic_Avg FROM st LEFT JOIN academic USING (c_custkey)",
        "c_custkey c_name c_nationkey c_acctbal* c_mktsegment n_name r_name score* Performance_Tier Academic_Avg*",
    ),
    "02_schools": ("SELECT * FROM supplier", "s_suppkey s_name s_nationkey s_acctbal*"),
    "03_grades": (f"SELECT g::INT AS Grade_Level, CASE {_CYCLES} END AS Cycle, CASE {_STAGES} END AS Stage FROM range(1, 13) AS r(g)", "Grade_Level Cycle Stage"),
    "04_behavior": ("SELECT * FROM behaviour_long", "c_custkey Grade_Level Subject Metric Value* Category"),
    "05_subject_performance": (
        "SELECT Grade_Level, Subject, Category, avg(Value) AS avg, count(Value) AS count, stddev_samp(Value) AS std FROM tests GROUP BY ALL",
        "Grade_Level Subject Category avg* count std*",
    ),
    "06_national_exams": ("SELECT * FROM exams", "user_id Subject Score*"),
    "07_region": ("SELECT r_name, count(c_custkey) AS n, avg(score) AS mean_value FROM st WHERE r_name IS NOT NULL GROUP BY r_name", "r_name n mean_value*"),
    "08_segment": (
        "SELECT c_mktsegment, count(c_custkey) AS n, avg(score) AS mean_value FROM st WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment",
        "c_mktsegment n mean_value*",
    ),
    "09_nation": ("SELECT n_name, count(c_custkey) AS n, avg(score) AS mean_value FROM st WHERE n_name IS NOT NULL GROUP BY n_name", "n_name n mean_value*"),
    "10_textbook": ("SELECT * FROM textbook", "c_custkey Grade_Level Subject Has_Textbook"),
    "11_attendance_correlation": (
        """SELECT c_custkey, Grade_Level, Subject, avg(Value) FILTER (WHERE Metric = 'Attendance') AS Attendance,
  avg(Value) FILTER (WHERE Metric = 'Test_Score') AS Test_Score FROM behaviour_long WHERE Metric IN ('Attendance', 'Test_Score') GROUP BY ALL""",
        "c_custkey Grade_Level Subject Attendance* Test_Score*",
    ),
    "12_school_performance": (
        """SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS mean_value, any_value(s_name) AS s_name, any_value(s_nationkey) AS s_nationkey
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey""",
        "l_suppkey n mean_value* s_name s_nationkey",
    ),
}
_TEXT = {"metric", "c_name", "c_mktsegment", "n_name", "r_name", "Performance_Tier", "s_name", "Cycle", "Stage", "Subject", "Metric", "Category"}


def _bits(text: str) -> str:
    return f"avg(('0x' || substr(md5({text}), 1, 8))::BIGINT::DOUBLE)"


def _contents_sql(name: str) -> str:
    rows, columns = _STAR[name]
    exact = [f"coalesce({c}::VARCHAR, '~')" for c in columns.split() if not c.endswith("*")]
    parts = [("(row)", "count(*)", _bits(f"concat_ws('|', {', '.join(exact)})"))]
    for c in columns.replace("*", "").split():
        parts.append((c, f"count({c})", _bits(c) if c in _TEXT else f"avg({c}::DOUBLE)"))
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", '{c}' AS "column", count(*) AS "rows", {n} AS non_null, round({v}, 3) AS checksum FROM "{name}" """ for c, n, v in parts
    )


_STAR_TABLES = _STAR_CTES + ",\n" + ",\n".join(f'"{n}" AS ({rows})' for n, (rows, _) in _STAR.items())


@register(
    "star_schema_export",
    sql=_STAR_TABLES
    + "\n"
    + " UNION ALL ".join(f"""SELECT '{n}' AS "table", 'saved' AS status, count(*) AS "rows" FROM "{n}" """ for n in _STAR),
    headline=True,
)
def star_schema_export(spark, sf):
    """Entry point A end to end: thirteen tables written as Parquet, and the
    manifest of what was stored."""
    manifest, _ = write_star_schema(spark, sf, scratch_path(spark, f"star/{uuid.uuid4().hex}"))
    return manifest.select("table", "status", "rows")


@register("star_schema_contents", sql=_STAR_TABLES + "\n" + " UNION ALL ".join(map(_contents_sql, _STAR)))
def star_schema_contents(spark, sf):
    """The delivered tables read back: rows, non-null cells and a checksum of every column."""
    manifest, tables = write_star_schema(spark, sf, scratch_path(spark, f"star/{uuid.uuid4().hex}"))
    paths = {r["table"]: r["path"] for r in manifest.collect()}  # one row a table
    out = None
    for name, df in tables.items():
        columns = _STAR[name][1].replace("*", "").split()
        part = io.column_contents(spark.read.schema(df.schema).parquet(paths[name]).select(*columns))
        part = part.select(F.lit(name).alias("table"), "column", "rows", "non_null", "checksum")
        out = part if out is None else out.unionByName(part)
    return finish(out, 3)
