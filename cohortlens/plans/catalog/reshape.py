"""Reshape and row-wise feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import config
from cohortlens.functions import categorize as cat
from cohortlens.operators import features as feat
from cohortlens.operators import reshape as rs
from cohortlens.plans import fixtures as fx
from cohortlens.plans.catalog.core import NUMERIC4, behaviour_long, behaviour_long_sql
from cohortlens.plans.registry import finish, register
from cohortlens.plans.sqlgen import q, row_mean_sql, row_std_sql, row_sum_sql
from cohortlens.sources.tables import load

STAGE_SHORT = config.METRICS  # metric keyword -> short name


def _cells_for(metric: str, grades, compat: bool = False) -> list[str]:
    names = fx.cell_names()
    return feat.stage_columns(names, metric if not compat or metric != "Class_Participation" else "Participation", grades, compat)


def _stage_sql(compat: bool = False) -> dict[str, str]:
    out = {}
    for kw, short in STAGE_SHORT.items():
        for stage, (lo, hi) in config.STAGES.items():
            out[f"Avg_{short}_{stage}"] = row_mean_sql(_cells_for(kw, range(lo, hi + 1), compat))
    return out


def _textbook_sql() -> dict[str, str]:
    out = {}
    for stage, (lo, hi) in config.STAGES.items():
        cols = _cells_for("Textbook", range(lo, hi + 1))
        vals = [f"(CASE WHEN {q(c)} = 'Yes' THEN 1.0 WHEN {q(c)} = 'No' THEN 0.0 END)" for c in cols]
        s = " + ".join(["0.0"] + [f"coalesce({v}, 0.0)" for v in vals])
        n = " + ".join(f"CAST({v} IS NOT NULL AS INTEGER)" for v in vals)
        out[feat.TEXTBOOK_STAGE_NAMES[stage]] = f"(({s}) / nullif({n}, 0))"
    return out


def stage_features(spark, sf, compat: bool = False):
    wide = fx.customer_wide(spark, sf)
    f = feat.stage_averages(wide, compat_prefix=compat)
    f = feat.textbook_access(f)
    f = feat.overall_averages(f)
    f = feat.engagement_weighted(f)
    return feat.growth_and_consistency(f)


def stage_features_sql(compat: bool = False) -> str:
    """CTE ``sfeat``: the stage, textbook, overall, engagement, growth and consistency columns."""
    st = _stage_sql(compat)
    tb = _textbook_sql()
    l1 = ",\n    ".join(f"{e} AS {q(k)}" for k, e in {**st, **tb}.items())
    stages = list(config.STAGES)
    overall = {
        "Overall_Avg_Attendance": row_mean_sql([f"Avg_Attendance_{s}" for s in stages]),
        "Overall_Avg_Homework": row_mean_sql([f"Avg_HW_Completion_{s}" for s in stages]),
        "Overall_Avg_Participation": row_mean_sql([f"Avg_Participation_{s}" for s in stages]),
        "Overall_Test_Score_Avg": row_mean_sql([f"Avg_Test_Score_{s}" for s in stages]),
        "Overall_Textbook_Access_Composite": row_mean_sql(list(feat.TEXTBOOK_STAGE_NAMES.values())),
    }
    l2 = ",\n    ".join(f"{e} AS {q(k)}" for k, e in overall.items())
    att = [f"Avg_Attendance_{s}" for s in stages] + ["Overall_Avg_Attendance"]
    return (
        fx.customer_wide_sql()
        + f""",
sf1 AS (SELECT c_custkey,
    {l1}
  FROM customer_wide),
sf2 AS (SELECT *,
    {l2}
  FROM sf1),
sfeat AS (SELECT *,
    Overall_Avg_Attendance * 0.4 + Overall_Avg_Homework * 0.3 + Overall_Avg_Participation * 0.3 AS Overall_Engagement_Score,
    Avg_Test_Score_Secondary - Avg_Test_Score_Lower_Primary AS Academic_Growth_Primary_to_Secondary,
    {row_std_sql(att)} AS Attendance_Consistency
  FROM sf2)"""
    )


def _sel_sql(cols) -> str:
    return ", ".join(f"round({q(c)}, 6) AS {q(c)}" for c in cols)


STAGE_COLS = [f"Avg_{s}_{st}" for s in STAGE_SHORT.values() for st in config.STAGES]
OVERALL_COLS = ["Overall_Avg_Attendance", "Overall_Avg_Homework", "Overall_Avg_Participation", "Overall_Test_Score_Avg"]
TEXTBOOK_COLS = list(feat.TEXTBOOK_STAGE_NAMES.values()) + ["Overall_Textbook_Access_Composite"]


# ---------------------------------------------------------------- H1 / H4
@register(
    "stage_averages",
    sql=fx.with_ctes(stage_features_sql()) + f"SELECT c_custkey, {_sel_sql(STAGE_COLS + OVERALL_COLS)} FROM sfeat",
    headline=True,
)
def stage_averages(spark, sf):
    return finish(stage_features(spark, sf).select("c_custkey", *STAGE_COLS, *OVERALL_COLS))


# ---------------------------------------------------------------- Q1 (prefix-compatible stages)
@register(
    "stage_averages_compat",
    sql=fx.with_ctes(stage_features_sql(compat=True)) + f"SELECT c_custkey, {_sel_sql(STAGE_COLS)} FROM sfeat",
)
def stage_averages_compat(spark, sf):
    return finish(stage_features(spark, sf, compat=True).select("c_custkey", *STAGE_COLS))


# ---------------------------------------------------------------- H2
@register(
    "textbook_access",
    sql=fx.with_ctes(stage_features_sql()) + f"SELECT c_custkey, {_sel_sql(TEXTBOOK_COLS)} FROM sfeat",
)
def textbook_access(spark, sf):
    return finish(stage_features(spark, sf).select("c_custkey", *TEXTBOOK_COLS))


# ---------------------------------------------------------------- H5
@register(
    "engagement_weighted",
    sql=fx.with_ctes(stage_features_sql()) + f"SELECT c_custkey, {_sel_sql(['Overall_Engagement_Score'])} FROM sfeat",
)
def engagement_weighted(spark, sf):
    return finish(stage_features(spark, sf).select("c_custkey", "Overall_Engagement_Score"))


# ---------------------------------------------------------------- H7 / H8
@register(
    "growth_consistency",
    sql=fx.with_ctes(stage_features_sql())
    + f"SELECT c_custkey, {_sel_sql(['Academic_Growth_Primary_to_Secondary', 'Attendance_Consistency'])} FROM sfeat",
)
def growth_consistency(spark, sf):
    return finish(
        stage_features(spark, sf).select("c_custkey", "Academic_Growth_Primary_to_Secondary", "Attendance_Consistency")
    )


# ---------------------------------------------------------------- R1 / R2
@register(
    "wide_to_long",
    sql=fx.with_ctes(behaviour_long_sql())
    + "SELECT c_custkey, Grade_Level, Subject, Metric, round(Value, 6) AS Value, Category FROM behaviour_long",
    headline=True,
)
def wide_to_long(spark, sf):
    return finish(behaviour_long(spark, sf))


@register(
    "name_parse",
    sql=fx.with_ctes(fx.customer_wide_sql(NUMERIC4))
    + """, unp AS (SELECT variable, value FROM (
    UNPIVOT (SELECT COLUMNS('^Grade_') FROM customer_wide) ON COLUMNS('^Grade_') INTO NAME variable VALUE value))
SELECT variable,
       CAST(regexp_extract(variable, '^Grade_(\\d+)_(.+?)_(Test_Score|Attendance|Homework_Completion|Class_Participation|Textbook)$', 1) AS INTEGER) AS grade,
       replace(regexp_extract(variable, '^Grade_(\\d+)_(.+?)_(Test_Score|Attendance|Homework_Completion|Class_Participation|Textbook)$', 2), '_', ' ') AS subject,
       regexp_extract(variable, '^Grade_(\\d+)_(.+?)_(Test_Score|Attendance|Homework_Completion|Class_Participation|Textbook)$', 3) AS metric,
       count(*) AS n_values
FROM unp WHERE value IS NOT NULL GROUP BY variable""",
)
def name_parse(spark, sf):
    """R1 as data: names arrive as the unpivot's variable column and are parsed
    with the regex grammar (only the distinct names are parsed)."""
    wide = fx.customer_wide(spark, sf, NUMERIC4)
    cols = [c for c in wide.columns if c.startswith("Grade_")]
    long = wide.select(*cols).unpivot([], cols, "variable", "value").where(F.col("value").isNotNull())
    names = long.groupBy("variable").agg(F.count(F.lit(1)).alias("n_values"))
    return names.select("variable", rs.parse_name_col("variable").alias("p"), "n_values").select(
        "variable", "p.grade", "p.subject", "p.metric", "n_values"
    )


# ---------------------------------------------------------------- R3
@register(
    "textbook_long",
    sql=fx.with_ctes(fx.customer_wide_sql(["Textbook"]))
    + """, tb AS (SELECT c_custkey, COLUMNS('^Grade_') FROM customer_wide),
unp AS (SELECT c_custkey, variable, value FROM tb UNPIVOT INCLUDE NULLS (value FOR variable IN (COLUMNS('^Grade_'))))
SELECT c_custkey,
       CAST(regexp_extract(variable, '^Grade_(\\d+)_(.+)_Textbook$', 1) AS INTEGER) AS Grade_Level,
       replace(regexp_extract(variable, '^Grade_(\\d+)_(.+)_Textbook$', 2), '_', ' ') AS Subject,
       CASE WHEN lower(trim(value)) IN ('yes', 'y', 'true', '1', 'available') THEN 1 ELSE 0 END AS Has_Textbook
FROM unp""",
)
def textbook_long(spark, sf):
    return rs.textbook_long(fx.customer_wide(spark, sf, ["Textbook"]), ["c_custkey"])


# ---------------------------------------------------------------- R4
@register(
    "exam_long",
    sql=fx.with_ctes(fx.EXAM_WIDE_SQL)
    + """SELECT user_id, Subject, round(Score, 6) AS Score FROM (
  SELECT user_id, replace(variable, 'Exam_', '') AS Subject, CAST(value AS DOUBLE) AS Score FROM (
    UNPIVOT exam_wide ON COLUMNS('^Exam_') INTO NAME variable VALUE value)) WHERE Score IS NOT NULL""",
)
def exam_long(spark, sf):
    return finish(rs.exam_long(fx.exam_wide(spark, sf), ["user_id"], "Exam_"))


# ---------------------------------------------------------------- H9
EXAM_COLS = [f"Exam_{t}" for t in fx.EVENT_TYPES]


@register(
    "total_exam",
    sql=fx.with_ctes(fx.EXAM_WIDE_SQL) + f"SELECT user_id, round({row_sum_sql(EXAM_COLS)}, 6) AS Total_Exam FROM exam_wide",
)
def total_exam(spark, sf):
    return finish(feat.total_of(fx.exam_wide(spark, sf), EXAM_COLS, "Total_Exam").select("user_id", "Total_Exam"))


# ---------------------------------------------------------------- H3 / E3
FIELD_OF_SEGMENT = {"AUTOMOBILE": 0, "BUILDING": 0, "FURNITURE": 0, "HOUSEHOLD": 1, "MACHINERY": 1}
EXAM_TRACKS = {
    "Social": ["Exam_click", "Exam_view"],
    "Natural": ["Exam_purchase", "Exam_signup"],
    "Common": ["Exam_error"],
}


def exam_people(spark, sf):
    ex = fx.exam_wide(spark, sf)
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    j = ex.join(c, ex.user_id == c.c_custkey, "left")
    return j.withColumn("Field_Choice", cat.lookup("c_mktsegment", FIELD_OF_SEGMENT))


TRACK_OUT = ["Social_Track_Subject_Avg", "Natural_Track_Subject_Avg", "Common_Exam_Average", "Track_Subject_Average", "Track_Exam_Average"]


@register(
    "track_averages",
    sql=fx.with_ctes(fx.EXAM_WIDE_SQL)
    + f""", ep AS (SELECT e.*, CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 0 WHEN 'FURNITURE' THEN 0
                     WHEN 'HOUSEHOLD' THEN 1 WHEN 'MACHINERY' THEN 1 END AS Field_Choice
           FROM exam_wide e LEFT JOIN customer c ON e.user_id = c.c_custkey),
t1 AS (SELECT user_id, Field_Choice,
         {row_mean_sql(EXAM_TRACKS['Social'])} AS Social_Track_Subject_Avg,
         {row_mean_sql(EXAM_TRACKS['Natural'])} AS Natural_Track_Subject_Avg,
         {row_mean_sql(EXAM_TRACKS['Common'])} AS Common_Exam_Average FROM ep),
t2 AS (SELECT *, CASE WHEN Field_Choice = 0 THEN Social_Track_Subject_Avg ELSE Natural_Track_Subject_Avg END AS Track_Subject_Average FROM t1)
SELECT user_id, Field_Choice, {_sel_sql(TRACK_OUT[:4])},
       round((Common_Exam_Average + Track_Subject_Average) / 2, 6) AS Track_Exam_Average FROM t2""",
)
def track_averages(spark, sf):
    t = feat.track_averages(exam_people(spark, sf), EXAM_TRACKS, "Field_Choice")
    return finish(t.select("user_id", "Field_Choice", *TRACK_OUT))


# ---------------------------------------------------------------- H10 / H11
@register(
    "age_parts",
    sql=f"""SELECT o_orderkey, CAST(floor(datediff('day', CAST(o_orderdate AS DATE), DATE '{config.REFERENCE_DATE}') / 365) AS DOUBLE) AS Age,
       CAST(year(o_orderdate) AS INTEGER) AS Birth_Year, CAST(month(o_orderdate) AS INTEGER) AS Birth_Month,
       CAST(day(o_orderdate) AS INTEGER) AS Birth_Day FROM orders""",
)
def age_parts(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return feat.age_parts(o, "o_orderdate").drop("o_orderdate")


# ---------------------------------------------------------------- J4
@register(
    "subject_category",
    sql=fx.with_ctes(behaviour_long_sql())
    + """SELECT Subject, Category,
       CASE WHEN contains(Subject, 'Math') OR contains(Subject, 'Physics') OR contains(Subject, 'Chemistry')
                 OR contains(Subject, 'Biology') OR contains(Subject, 'ICT') OR contains(Subject, 'Technical') THEN 'STEM'
            WHEN contains(Subject, 'History') OR contains(Subject, 'Geography') OR contains(Subject, 'Economics')
                 OR contains(Subject, 'Civics') OR contains(Subject, 'Social') OR contains(Subject, 'Business') THEN 'Humanities'
            ELSE 'Language/Other' END AS Category3, count(*) AS n
FROM behaviour_long GROUP BY Subject, Category""",
)
def subject_category(spark, sf):
    long = behaviour_long(spark, sf)
    g = long.groupBy("Subject", "Category").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn(
        "Category3",
        cat.subject_category("Subject", config.SUBJECT_CATEGORIES_3WAY, config.SUBJECT_CATEGORY_3WAY_DEFAULT),
    ).select("Subject", "Category", "Category3", "n")


# ---------------------------------------------------------------- R5
@register(
    "long_to_wide",
    sql=fx.with_ctes(behaviour_long_sql())
    + """SELECT c_custkey, Grade_Level, Subject,
       round(avg(CASE WHEN Metric = 'Attendance' THEN Value END), 6) AS Attendance,
       round(avg(CASE WHEN Metric = 'Test_Score' THEN Value END), 6) AS Test_Score
FROM behaviour_long WHERE Metric IN ('Attendance', 'Test_Score') GROUP BY c_custkey, Grade_Level, Subject""",
)
def long_to_wide(spark, sf):
    long = behaviour_long(spark, sf, ["Test_Score", "Attendance"]).where(F.col("Metric").isin("Attendance", "Test_Score"))
    return finish(rs.long_to_wide(long, ["c_custkey", "Grade_Level", "Subject"], "Metric", ["Attendance", "Test_Score"], "Value"))


# ---------------------------------------------------------------- W6
@register(
    "union_tables",
    sql="""SELECT 'customer' AS source, c_nationkey AS nationkey, count(*) AS n FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'supplier' AS source, s_nationkey AS nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey""",
)
def union_tables(spark, sf):
    c = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n"))
    s = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return rs.union_all([c.withColumn("source", F.lit("customer")), s.withColumn("source", F.lit("supplier"))]).select(
        "source", "nationkey", "n"
    )
