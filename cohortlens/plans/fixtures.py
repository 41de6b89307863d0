"""Inputs the registered queries derive from the driver's parquet tables.

The operators are generic; these builders feed them analogous columns of the
TPC-H-like tables (the role mapping of SURVEY §7.3).  Every Spark builder has an
SQL twin (``*_SQL`` / ``*_sql()``) that the oracle queries reuse as CTEs, so both
sides start from the same derived table.

- ``people``: customer ⟕ nation ⟕ region (entity with a region and a score).
- ``order_people``: orders ⟕ customer ⟕ nation ⟕ region (score = o_totalprice).
- ``cells``: lineitem ⋈ orders aggregated per (customer, month, flag_status):
  four numeric metrics and a Yes/No textbook flag.
- ``customer_wide``: customer ⟕ cells pivoted to ``Grade_<m>_<subject>_<Metric>``
  columns (months 1-12 give real ``Grade_1`` vs ``Grade_10`` names).
- ``exam_wide``: events pivoted per user to ``Exam_<event_type>`` means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.tables import load
from cohortlens.operators.sizing import broadcast_if_small, estimated_bytes
from cohortlens.session import size_shuffles, wide_plan_guard

# FIXED VALUES of the fixture tables (checked against the data): return flags,
# line statuses, months and event types.
FLAG_STATUS = ["A_F", "A_O", "N_F", "N_O", "R_F", "R_O"]
MONTHS = list(range(1, 13))
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
CELL_METRICS = ["Test_Score", "Attendance", "Homework_Completion", "Class_Participation", "Textbook"]


def cell_names(metrics=CELL_METRICS) -> list[str]:
    return [f"Grade_{m}_{s}_{k}" for m in MONTHS for s in FLAG_STATUS for k in metrics]


def people(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = load(spark, sf, "region").select("r_regionkey", "r_name")
    nr = n.join(broadcast_if_small(r), n.n_regionkey == r.r_regionkey, "left").drop("r_regionkey", "n_regionkey")
    return c.join(broadcast_if_small(nr), c.c_nationkey == nr.n_nationkey, "left").drop("n_nationkey")


PEOPLE_SQL = """people AS (
  SELECT c.*, n.n_name, r.r_name
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def order_people(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    p = people(spark, sf).select("c_custkey", "c_mktsegment", "c_acctbal", "n_name", "r_name")
    return o.join(p, o.o_custkey == p.c_custkey, "left").drop("c_custkey")


ORDER_PEOPLE_SQL = PEOPLE_SQL + """,
order_people AS (
  SELECT o.*, p.c_mktsegment, p.c_acctbal, p.n_name, p.r_name
  FROM orders o LEFT JOIN people p ON o.o_custkey = p.c_custkey)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Per (customer, month, flag_status) metric means; partial aggregation runs
    map-side, so a customer holding a large share of lines is combined before
    the shuffle (at most 72 cells per customer leave each task)."""
    li = load(spark, sf, "lineitem")
    parts = size_shuffles(spark, estimated_bytes(li))
    li = li.where("l_orderkey IS NOT NULL").select(
        "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    o = load(spark, sf, "orders").where("o_orderkey IS NOT NULL").select("o_orderkey", "o_custkey")
    if parts:
        li, o = li.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    # the textbook flag is aggregated as an int (max of 0/1) so the aggregate
    # stays a hash aggregate; a string max would force a sort-based one
    g = j.groupBy(
        F.col("o_custkey").alias("cid"),
        F.month("l_shipdate").alias("grade"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("subject"),
    ).agg(
        F.avg(F.col("l_quantity") * 2).alias("Test_Score"),
        F.avg(100 * (1 - F.col("l_discount"))).alias("Attendance"),
        F.avg(100 * (1 - F.col("l_tax"))).alias("Homework_Completion"),
        F.avg(F.col("l_linenumber") * 14).alias("Class_Participation"),
        F.max(F.when(F.col("l_discount") >= 0.05, 1).otherwise(0)).alias("_tb"),
    )
    return g.withColumn("Textbook", F.when(F.col("_tb") == 1, "Yes").otherwise("No")).drop("_tb")


CELLS_SQL = """cells AS (
  SELECT o_custkey AS cid, CAST(month(l_shipdate) AS INTEGER) AS grade,
         l_returnflag || '_' || l_linestatus AS subject,
         avg(l_quantity * 2) AS Test_Score,
         avg(100 * (1 - l_discount)) AS Attendance,
         avg(100 * (1 - l_tax)) AS Homework_Completion,
         avg(l_linenumber * 14) AS Class_Participation,
         max(CASE WHEN l_discount >= 0.05 THEN 'Yes' ELSE 'No' END) AS Textbook
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2, 3)"""


def customer_wide(spark: SparkSession, sf: str, metrics=CELL_METRICS, cells_df: DataFrame | None = None) -> DataFrame:
    """One row per customer with ``Grade_<m>_<subject>_<Metric>`` columns (null
    where the customer has no line in that cell; all-null without orders).
    ``cells_df`` lets several outputs share one stored cell table.

    The cells (at most 72 a customer) are dealt by customer before the pivot: its
    map-side half, on cells dealt by customer, month and subject, would hold a wide
    row of nearly every customer in every task."""
    wide_plan_guard(spark)
    cl = (cells_df if cells_df is not None else cells(spark, sf)).withColumn("cell", F.concat(F.lit("Grade_"), F.col("grade"), F.lit("_"), F.col("subject")))
    cell_vals = [f"Grade_{m}_{s}" for m in MONTHS for s in FLAG_STATUS]
    # pivot numbers only (textbook as a 0/1 int) so the pivot aggregate is a hash aggregate
    aggs = [F.first(F.col(k) if k != "Textbook" else (F.col(k) == "Yes").cast("int")).alias(k) for k in metrics]
    parts = size_shuffles(spark, estimated_bytes(load(spark, sf, "lineitem")))
    dealt = cl.repartition(parts, "cid") if parts else cl.repartition("cid")
    wide = dealt.groupBy("cid").pivot("cell", cell_vals).agg(*aggs)
    if len(metrics) == 1:  # Spark omits the alias suffix for a single aggregate
        wide = wide.select("cid", *[F.col(v).alias(f"{v}_{metrics[0]}") for v in cell_vals])
    if "Textbook" in metrics:
        tb = [f"{v}_Textbook" for v in cell_vals]
        wide = wide.withColumns({c: F.when(F.col(c) == 1, "Yes").when(F.col(c) == 0, "No") for c in tb})
    c = load(spark, sf, "customer")
    out = c.join(wide, c.c_custkey == wide.cid, "left").drop("cid")
    return out.select(*c.columns, *[f"{v}_{k}" for v in cell_vals for k in metrics])


def customer_wide_sql(metrics=CELL_METRICS) -> str:
    cols = ",\n    ".join(
        f"max(CASE WHEN grade = {m} AND subject = '{s}' THEN {k} END) AS Grade_{m}_{s}_{k}"
        for m in MONTHS
        for s in FLAG_STATUS
        for k in metrics
    )
    names = ", ".join(f"w.Grade_{m}_{s}_{k}" for m in MONTHS for s in FLAG_STATUS for k in metrics)
    return (
        CELLS_SQL
        + f""",
wide_cells AS (
  SELECT cid,
    {cols}
  FROM cells GROUP BY cid),
customer_wide AS (
  SELECT c.*, {names}
  FROM customer c LEFT JOIN wide_cells w ON c.c_custkey = w.cid)"""
    )


def exam_wide(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", "event_type", "value")
    w = e.groupBy("user_id").pivot("event_type", EVENT_TYPES).agg(F.avg("value"))
    return w.select("user_id", *[F.col(t).alias(f"Exam_{t}") for t in EVENT_TYPES])


EXAM_WIDE_SQL = (
    "exam_wide AS (\n  SELECT user_id, "
    + ", ".join(f"avg(CASE WHEN event_type = '{t}' THEN value END) AS Exam_{t}" for t in EVENT_TYPES)
    + "\n  FROM events GROUP BY user_id)"
)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
