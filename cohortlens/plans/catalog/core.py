"""Core reports, filters, predicates and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import config
from cohortlens.functions import categorize as cat
from cohortlens.operators import clean, report
from cohortlens.operators.reshape import wide_to_long
from cohortlens.operators.sizing import broadcast_if_small
from cohortlens.plans import fixtures as fx
from cohortlens.plans.registry import finish, register
from cohortlens.sources import prepare
from cohortlens.sources.tables import load

ORDER_MARK = 200000.0  # "high" order value (plays the exam pass mark)
BALANCE_MARK = 4500.0  # balance pass / risk mark
NUMERIC4 = ["Test_Score", "Attendance", "Homework_Completion", "Class_Participation"]


def behaviour_long(spark, sf, metrics=NUMERIC4):
    """R2 over the customer-wide fixture, with the subject category.

    ``metrics`` narrows the unpivot (and the pivot that builds the fixture) to
    the metrics a query uses: a filter on the unpivoted ``Metric`` literal is
    not pushed into the ``Expand`` by Catalyst, so it is applied here."""
    wide = fx.customer_wide(spark, sf, list(metrics))
    long = wide_to_long(wide, ["c_custkey"], list(metrics))
    return long.withColumn("Category", cat.subject_category("Subject"))


def behaviour_long_sql() -> str:
    """The same long table in SQL: DuckDB UNPIVOT + regex parse of the names."""
    rx = "'^Grade_(\\d+)_(.+?)_(Test_Score|Attendance|Homework_Completion|Class_Participation)$'"
    cats = " ".join(
        f"WHEN {' OR '.join(f'contains(Subject, {chr(39)}{s}{chr(39)})' for s in subs)} THEN '{label}'"
        for label, subs in config.SUBJECT_CATEGORIES
    )
    return (
        fx.customer_wide_sql(NUMERIC4)
        + f""",
unp AS (
  SELECT c_custkey, variable, value FROM (
    UNPIVOT (SELECT c_custkey, COLUMNS('^Grade_') FROM customer_wide)
    ON COLUMNS('^Grade_') INTO NAME variable VALUE value)),
parsed AS (
  SELECT c_custkey,
         CAST(regexp_extract(variable, {rx}, 1) AS INTEGER) AS Grade_Level,
         replace(regexp_extract(variable, {rx}, 2), '_', ' ') AS Subject,
         regexp_extract(variable, {rx}, 3) AS Metric,
         CAST(value AS DOUBLE) AS Value
  FROM unp WHERE value IS NOT NULL AND value BETWEEN 0 AND 100),
behaviour_long AS (
  SELECT *, CASE {cats} ELSE '{config.SUBJECT_CATEGORY_DEFAULT}' END AS Category FROM parsed)"""
    )


# ---------------------------------------------------------------- A13 (flagship)
@register(
    "region_exam_table",
    sql=fx.with_ctes(fx.ORDER_PEOPLE_SQL)
    + f"""SELECT r_name, count(*) AS total,
       count(*) FILTER (WHERE o_totalprice >= {ORDER_MARK}) AS n_high,
       count(*) FILTER (WHERE o_totalprice < {ORDER_MARK}) AS n_low,
       round(avg(o_totalprice), 6) AS mean_value,
       min(o_totalprice) AS min_value, max(o_totalprice) AS max_value,
       round(100 * count(*) FILTER (WHERE o_totalprice >= {ORDER_MARK}) / count(*), 6) AS pct_high
FROM order_people WHERE r_name IS NOT NULL GROUP BY r_name ORDER BY mean_value DESC""",
    headline=True,
)
def region_exam_table(spark, sf):
    return finish(report.threshold_group_table(fx.order_people(spark, sf), "r_name", "o_totalprice", ORDER_MARK))


# ---------------------------------------------------------------- A9
@register(
    "kpi_overview",
    sql=f"""SELECT count(*) AS total, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median,
       round(stddev_samp(c_acctbal), 6) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max,
       round(100 * avg(CAST(coalesce(c_acctbal >= {BALANCE_MARK}, false) AS INTEGER)), 6) AS pass_rate,
       count(*) FILTER (WHERE c_acctbal < {BALANCE_MARK}) AS risk_count,
       round(100 * avg(CAST(coalesce(c_acctbal < {BALANCE_MARK}, false) AS INTEGER)), 6) AS risk_rate
FROM customer""",
)
def kpi_overview(spark, sf):
    return finish(report.kpi_overview(load(spark, sf, "customer"), "c_acctbal", BALANCE_MARK, BALANCE_MARK))


# ---------------------------------------------------------------- A7 / A8
@register(
    "value_counts_share",
    sql="""SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""",
)
def value_counts_share(spark, sf):
    return finish(report.value_counts(load(spark, sf, "customer"), "c_mktsegment", normalize=True))


# ---------------------------------------------------------------- A1 (+R2, J4)
@register(
    "subject_performance",
    sql=fx.with_ctes(behaviour_long_sql())
    + """SELECT Grade_Level, Subject, Category, round(avg(Value), 6) AS avg, count(Value) AS count,
       round(stddev_samp(Value), 6) AS std
FROM behaviour_long WHERE Metric = 'Test_Score' GROUP BY Grade_Level, Subject, Category""",
    headline=True,
)
def subject_performance(spark, sf):
    long = behaviour_long(spark, sf, ["Test_Score"]).where(F.col("Metric") == "Test_Score")
    return finish(report.group_stats(long, ["Grade_Level", "Subject", "Category"], "Value"))


# ---------------------------------------------------------------- A2 / J1
@register(
    "student_avg_join",
    sql=fx.with_ctes(behaviour_long_sql(), fx.PEOPLE_SQL)
    + """, acad AS (SELECT c_custkey, avg(Value) AS academic_avg FROM behaviour_long
                WHERE Metric = 'Test_Score' GROUP BY c_custkey)
SELECT p.c_custkey, p.c_name, p.r_name, round(a.academic_avg, 6) AS academic_avg
FROM people p LEFT JOIN acad a ON p.c_custkey = a.c_custkey""",
)
def student_avg_join(spark, sf):
    acad = report.per_key_mean(
        behaviour_long(spark, sf, ["Test_Score"]).where(F.col("Metric") == "Test_Score"), "c_custkey", "Value", "academic_avg"
    )
    dim = fx.people(spark, sf).select("c_custkey", "c_name", "r_name")
    return finish(dim.join(acad, "c_custkey", "left"))


# ---------------------------------------------------------------- A4 / J2
@register(
    "school_summary",
    sql="""WITH s AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS mean_value FROM lineitem
           WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey)
SELECT s.l_suppkey, s.n, round(s.mean_value, 6) AS mean_value, d.s_name, d.s_nationkey, d.s_acctbal
FROM s LEFT JOIN supplier d ON s.l_suppkey = d.s_suppkey""",
)
def school_summary(spark, sf):
    summ = report.group_count_mean(load(spark, sf, "lineitem"), "l_suppkey", "l_quantity")
    dim = load(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    j = summ.join(broadcast_if_small(dim), summ.l_suppkey == dim.s_suppkey, "left").drop("s_suppkey")
    return finish(j)


# ---------------------------------------------------------------- A3
@register(
    "grouping_summaries",
    sql=fx.with_ctes(fx.ORDER_PEOPLE_SQL)
    + """, g AS (
  SELECT r_name, c_mktsegment, o_orderpriority, count(o_orderkey) AS n, avg(o_totalprice) AS mean_value,
         grouping(r_name) AS gr, grouping(c_mktsegment) AS gm, grouping(o_orderpriority) AS gp
  FROM order_people GROUP BY GROUPING SETS ((r_name), (c_mktsegment), (o_orderpriority)))
SELECT CASE WHEN gr = 0 THEN 'r_name' WHEN gm = 0 THEN 'c_mktsegment' ELSE 'o_orderpriority' END AS dimension,
       CASE WHEN gr = 0 THEN r_name WHEN gm = 0 THEN c_mktsegment ELSE o_orderpriority END AS member,
       n, round(mean_value, 6) AS mean_value
FROM g
WHERE (CASE WHEN gr = 0 THEN r_name WHEN gm = 0 THEN c_mktsegment ELSE o_orderpriority END) IS NOT NULL""",
)
def grouping_summaries(spark, sf):
    op = fx.order_people(spark, sf)
    return finish(report.grouping_summaries(op, ["r_name", "c_mktsegment", "o_orderpriority"], "o_orderkey", "o_totalprice"))


# ---------------------------------------------------------------- A11 / P14
@register(
    "band_report",
    sql="""WITH b AS (SELECT l_quantity * 2 AS score, l_discount, l_tax,
                CASE WHEN l_quantity * 2 < 50 THEN 'Low' WHEN l_quantity * 2 < 70 THEN 'Medium'
                     WHEN l_quantity IS NOT NULL THEN 'High' END AS band FROM lineitem),
     t AS (SELECT count(*) AS total FROM lineitem)
SELECT band, count(*) AS n, round(avg(score), 6) AS mean_value, round(avg(l_discount), 6) AS mean_l_discount,
       round(avg(l_tax), 6) AS mean_l_tax, round(100 * count(*) / any_value(t.total), 6) AS pct
FROM b, t WHERE band IS NOT NULL GROUP BY band""",
    headline=True,
)
def band_report(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("score", F.col("l_quantity") * 2)
    return finish(report.band_report(li, "score", ["l_discount", "l_tax"]))


# ---------------------------------------------------------------- P13
@register(
    "tier_bins",
    sql="""SELECT tier, count(*) AS n FROM (
  SELECT CASE WHEN s > 0 AND s <= 50 THEN 'Critical' WHEN s > 50 AND s <= 70 THEN 'Needs Improvement'
              WHEN s > 70 AND s <= 85 THEN 'Satisfactory' WHEN s > 85 AND s <= 100 THEN 'Excellent' END AS tier
  FROM (SELECT l_quantity * 2 AS s FROM lineitem)) GROUP BY tier""",
)
def tier_bins(spark, sf):
    li = load(spark, sf, "lineitem").select(cat.tier_bin(F.col("l_quantity") * 2).alias("tier"))
    return li.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- A12
@register(
    "threshold_split",
    sql=f"""SELECT count(*) AS total, count(*) FILTER (WHERE o_totalprice >= {ORDER_MARK}) AS n_pass,
       count(*) FILTER (WHERE o_totalprice < {ORDER_MARK}) AS n_fail,
       round(100 * count(*) FILTER (WHERE o_totalprice >= {ORDER_MARK}) / count(*), 6) AS pct_pass,
       round(100 * count(*) FILTER (WHERE o_totalprice < {ORDER_MARK}) / count(*), 6) AS pct_fail,
       round(avg(CASE WHEN o_totalprice >= {ORDER_MARK} THEN o_totalprice END), 6) AS mean_pass,
       round(avg(CASE WHEN o_totalprice < {ORDER_MARK} THEN o_totalprice END), 6) AS mean_fail
FROM orders""",
)
def threshold_split(spark, sf):
    return finish(report.threshold_split(load(spark, sf, "orders"), "o_totalprice", ORDER_MARK))


# ---------------------------------------------------------------- P6 / P7
@register(
    "filter_search",
    sql=fx.with_ctes(fx.ORDER_PEOPLE_SQL)
    + """SELECT o_orderkey, o_custkey, r_name, o_totalprice FROM order_people
WHERE r_name = 'ASIA' AND o_totalprice BETWEEN 100000 AND 300000
  AND CAST(o_orderkey AS VARCHAR) ILIKE '%77%'""",
)
def filter_search(spark, sf):
    op = fx.order_people(spark, sf)
    f = clean.filter_rows(op, {"r_name": "ASIA", "o_orderstatus": "All"}, {"o_totalprice": (100000, 300000)})
    return clean.id_search(f, "o_orderkey", "77").select("o_orderkey", "o_custkey", "r_name", "o_totalprice")


# ---------------------------------------------------------------- P8
@register("point_lookup", sql="SELECT * FROM orders WHERE o_orderkey = 42")
def point_lookup(spark, sf):
    return clean.point_lookup(load(spark, sf, "orders"), "o_orderkey", 42)


# ---------------------------------------------------------------- P10
@register(
    "dedupe_first",
    sql="""SELECT * FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def dedupe_first(spark, sf):
    o = load(spark, sf, "orders")
    return clean.dedupe_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(*o.columns)


# ---------------------------------------------------------------- P11
@register(
    "dup_rows",
    sql="""SELECT md5(text) AS text_md5, count(*) AS n_copies FROM documents GROUP BY text HAVING count(*) > 1""",
)
def dup_rows(spark, sf):
    d = clean.duplicate_rows(load(spark, sf, "documents").select("text"))
    return d.select(F.md5("text").alias("text_md5"), "n_copies")


# ---------------------------------------------------------------- P16
@register(
    "yes_no_decode",
    sql=fx.with_ctes(fx.CELLS_SQL)
    + """SELECT cid, grade, subject,
       CASE WHEN lower(trim(Textbook)) IN ('yes', 'y', 'true', '1', 'available') THEN 1 ELSE 0 END AS has_textbook
FROM cells""",
)
def yes_no_decode(spark, sf):
    c = fx.cells(spark, sf)
    return c.select("cid", "grade", "subject", cat.yes_no_decode("Textbook").alias("has_textbook"))


# ---------------------------------------------------------------- P15
@register(
    "parental_decode",
    sql="""SELECT c_custkey, CASE WHEN v IS NULL THEN 'Unknown' WHEN v < 0.33 THEN 'Low'
                      WHEN v < 0.66 THEN 'Medium' ELSE 'High' END AS level
FROM (SELECT c_custkey, c_acctbal / 10000 AS v FROM customer)""",
)
def parental_decode(spark, sf):
    c = load(spark, sf, "customer")
    return c.select("c_custkey", cat.parental_decode(F.col("c_acctbal") / 10000).alias("level"))


# ---------------------------------------------------------------- P17 / P12
@register(
    "risk_flag",
    sql=f"""SELECT c_custkey, CAST(c_acctbal < {BALANCE_MARK} AS INTEGER) AS at_risk,
       CAST(c_acctbal >= {BALANCE_MARK} AS INTEGER) AS passed,
       CASE WHEN c_acctbal < {BALANCE_MARK} THEN 'At Risk' ELSE 'Not At Risk' END AS status
FROM customer""",
)
def risk_flag(spark, sf):
    c = load(spark, sf, "customer")
    return c.select(
        "c_custkey",
        clean.flag_below("c_acctbal", BALANCE_MARK).alias("at_risk"),
        clean.flag_at_least("c_acctbal", BALANCE_MARK).alias("passed"),
        F.when(F.col("c_acctbal") < BALANCE_MARK, "At Risk").otherwise("Not At Risk").alias("status"),
    )


# ---------------------------------------------------------------- P9 / P4 / P5
@register(
    "long_metric_filter",
    sql=fx.with_ctes(behaviour_long_sql())
    + """SELECT Metric, Grade_Level, count(*) AS n, round(avg(Value), 6) AS mean_value FROM behaviour_long
WHERE Metric IN ('Test_Score', 'Attendance') AND Value BETWEEN 0 AND 100 AND Value IS NOT NULL
GROUP BY Metric, Grade_Level""",
)
def long_metric_filter(spark, sf):
    long = behaviour_long(spark, sf, ["Test_Score", "Attendance"]).where(F.col("Metric").isin("Test_Score", "Attendance"))
    long = clean.drop_nulls(clean.in_range(long, "Value", 0, 100), ["Value"])
    return finish(long.groupBy("Metric", "Grade_Level").agg(F.count(F.lit(1)).alias("n"), F.avg("Value").alias("mean_value")))


# ---------------------------------------------------------------- J3
PRIORITY_LEVEL = {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1, "4-NOT SPECIFIED": 0}


@register(
    "lookup_join",
    sql="""SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2
                     WHEN '3-MEDIUM' THEN 1 WHEN '4-NOT SPECIFIED' THEN 0 END, 1) AS priority_level,
       s.share AS status_share
FROM orders o LEFT JOIN (SELECT o_orderstatus AS st, round(count(*) / sum(count(*)) OVER (), 6) AS share
                         FROM orders GROUP BY o_orderstatus) s ON o.o_orderstatus = s.st""",
)
def lookup_join(spark, sf):
    """Constant dict -> literal map with a default; data-derived dict (status
    share) -> aggregate joined back (its size is the number of statuses)."""
    o = load(spark, sf, "orders")
    shares = finish(report.value_counts(o, "o_orderstatus", normalize=True)).select(
        F.col("o_orderstatus").alias("st"), F.col("share").alias("status_share")
    )
    j = o.join(broadcast_if_small(shares), o.o_orderstatus == shares.st, "left")
    return j.select("o_orderkey", cat.lookup("o_orderpriority", PRIORITY_LEVEL, 1).alias("priority_level"), "status_share")


# ---------------------------------------------------------------- W3 / W4
@register(
    "topk_abs",
    sql="""SELECT o_orderkey, o_totalprice, round(abs(o_totalprice - 250000), 6) AS distance FROM orders
ORDER BY abs(o_totalprice - 250000) DESC, o_orderkey LIMIT 10""",
)
def topk_abs(spark, sf):
    """A top-k report: the limit is the feature (TakeOrderedAndProject, no full sort)."""
    o = load(spark, sf, "orders").withColumn("distance", F.abs(F.col("o_totalprice") - 250000))
    return finish(o.orderBy(F.desc("distance"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice", "distance"))


# ---------------------------------------------------------------- W5
@register(
    "argmax_region",
    sql=fx.with_ctes(fx.ORDER_PEOPLE_SQL)
    + """, g AS (SELECT r_name, avg(o_totalprice) AS m FROM order_people WHERE r_name IS NOT NULL GROUP BY r_name)
SELECT arg_max(r_name, m) AS top_region, round(max(m), 6) AS top_mean,
       arg_min(r_name, m) AS bottom_region, round(min(m), 6) AS bottom_mean FROM g""",
)
def argmax_region(spark, sf):
    g = report.per_key_mean(fx.order_people(spark, sf), "r_name", "o_totalprice", "m")
    return finish(
        g.agg(
            F.max_by("r_name", "m").alias("top_region"),
            F.max("m").alias("top_mean"),
            F.min_by("r_name", "m").alias("bottom_region"),
            F.min("m").alias("bottom_mean"),
        )
    )


# ---------------------------------------------------------------- S8
@register(
    "default_fill",
    sql="SELECT c_custkey, "
    + ", ".join(
        f"CAST({v} AS DOUBLE) AS {k}" for k, v in config.DEFAULT_FILLS.items()
    )
    + ", c_acctbal FROM customer",
)
def default_fill(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    filled = prepare.default_fill(c, config.DEFAULT_FILLS)
    return filled.select("c_custkey", *config.DEFAULT_FILLS, "c_acctbal")


# ---------------------------------------------------------------- S9
@register(
    "id_normalise",
    sql="""SELECT c_custkey, coalesce(TRY_CAST(c_name AS BIGINT),
                 row_number() OVER (ORDER BY c_custkey)) AS norm_id
FROM customer""",
)
def id_normalise(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_name")
    return prepare.normalise_ids(c, "c_name", ["c_custkey"], out="norm_id").select("c_custkey", "norm_id")


# ---------------------------------------------------------------- P1-P3 / P12 / S6 / W7
@register(
    "leak_drop",
    sql="""SELECT o_orderkey, o_custkey, o_orderdate,
       CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS closed_value FROM orders""",
)
def leak_drop(spark, sf):
    o = load(spark, sf, "orders")
    o = clean.project_existing(o, ["o_orderkey", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "no_such_col"])
    o = o.withColumns({"closed_value": F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(F.lit(0.0))})
    return clean.drop_columns(o, names=["o_totalprice"], contains_ci=["STATUS"])
