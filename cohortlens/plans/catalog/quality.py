"""Quality, profile and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import profile, report, stats
from cohortlens.operators.reshape import stat_table as stat_table_op
from cohortlens.plans import fixtures as fx
from cohortlens.plans.catalog.core import BALANCE_MARK, NUMERIC4, ORDER_MARK, behaviour_long, behaviour_long_sql
from cohortlens.plans.catalog.reshape import EXAM_TRACKS, stage_features, stage_features_sql
from cohortlens.plans.registry import finish, register
from cohortlens.plans.sqlgen import q
from cohortlens.sources.tables import load

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long_sql(table: str, cols, cast: str = "DOUBLE") -> str:
    """``(column, value)`` rows of a table in SQL."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({q(c)} AS {cast}) AS value FROM {table}" for c in cols)


# ---------------------------------------------------------------- S2
@register(
    "validate_input",
    sql="""SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_null_keys,
       count(o_orderkey) - count(DISTINCT o_orderkey) AS n_duplicate_keys,
       count(*) FILTER (WHERE o_totalprice IS NULL) AS n_null_target FROM orders""",
)
def validate_input(spark, sf):
    return profile.validate_input(load(spark, sf, "orders"), "o_orderkey", "o_totalprice", ["o_custkey"])


# ---------------------------------------------------------------- A17
def _wide_numeric(spark, sf):
    return fx.customer_wide(spark, sf, NUMERIC4)


_WIDE_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"] + fx.cell_names(NUMERIC4)


@register(
    "null_profile",
    sql=fx.with_ctes(fx.customer_wide_sql(NUMERIC4))
    + ", agg AS (SELECT count(*) AS _n, "
    + ", ".join(f"count(*) FILTER (WHERE {q(c)} IS NULL) AS {q(c)}" for c in _WIDE_COLS)
    + " FROM customer_wide)\n"
    + """SELECT "column", n_null, round(100 * n_null / _n, 6) AS pct_null FROM (
  UNPIVOT agg ON COLUMNS(* EXCLUDE (_n)) INTO NAME "column" VALUE n_null)""",
)
def null_profile(spark, sf):
    return finish(profile.null_profile(_wide_numeric(spark, sf)))


# ---------------------------------------------------------------- A18
_ORDER_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}


@register(
    "dtype_profile",
    sql="WITH lv AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS col, '{t}' AS dtype, CAST({c} AS VARCHAR) AS v FROM orders" for c, t in _ORDER_TYPES.items()
    )
    + """),
per AS (SELECT col, dtype, 100.0 * count(*) FILTER (WHERE v IS NULL) / count(*) AS pct_null,
               count(DISTINCT v) AS n_unique FROM lv GROUP BY col, dtype)
SELECT dtype, count(*) AS n_columns, round(avg(pct_null), 6) AS mean_pct_null, max(n_unique) AS max_unique
FROM per GROUP BY dtype""",
)
def dtype_profile(spark, sf):
    return finish(profile.dtype_profile(load(spark, sf, "orders")))


# ---------------------------------------------------------------- A20
_CATS = ["o_orderstatus", "o_orderpriority"]


@register(
    "cardinality",
    sql="WITH lv AS (" + _long_sql("orders", _CATS, "VARCHAR") + """)
SELECT "column", count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS n_unique_with_null,
       count(DISTINCT value) AS n_unique FROM lv GROUP BY "column" """,
)
def cardinality(spark, sf):
    return profile.cardinality(load(spark, sf, "orders"), _CATS)


@register(
    "distinct_values",
    sql="WITH lv AS (" + _long_sql("orders", _CATS, "VARCHAR") + """)
SELECT "column", value, count(*) AS n FROM lv GROUP BY "column", value""",
)
def distinct_values(spark, sf):
    return profile.distinct_values(load(spark, sf, "orders"), _CATS)


# ---------------------------------------------------------------- A16
@register(
    "describe",
    sql="WITH lv AS (" + _long_sql("lineitem", LI_NUM) + """)
SELECT "column", count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
       round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max
FROM lv WHERE value IS NOT NULL GROUP BY "column" """,
    headline=True,
)
def describe(spark, sf):
    return finish(profile.describe(load(spark, sf, "lineitem"), LI_NUM))


# ---------------------------------------------------------------- R6
@register(
    "stat_table",
    sql="WITH lv AS (" + _long_sql("lineitem", LI_NUM) + """),
s AS (SELECT "column" AS feature, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max
      FROM lv GROUP BY "column")
SELECT feature, stat, round(value, 6) AS value FROM (UNPIVOT s ON mean, std, min, max INTO NAME stat VALUE value)""",
)
def stat_table(spark, sf):
    st = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return finish(stat_table_op(load(spark, sf, "lineitem"), LI_NUM, st))


# ---------------------------------------------------------------- A21
@register(
    "scale_check",
    sql="WITH lv AS (" + _long_sql("lineitem", LI_NUM) + """)
SELECT "column", min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
       count(*) FILTER (WHERE value < 0 OR value > 100) AS n_out_of_range,
       CASE WHEN max(value) <= 1 THEN '0-1' ELSE '0-100' END AS scale
FROM lv GROUP BY "column" """,
)
def scale_check(spark, sf):
    return finish(profile.scale_check(load(spark, sf, "lineitem"), LI_NUM))


# ---------------------------------------------------------------- A26
@register(
    "skewness",
    sql="WITH lv AS (" + _long_sql("lineitem", LI_NUM) + """)
SELECT "column", round(skewness(value), 6) AS skew FROM lv GROUP BY "column" """,
)
def skewness(spark, sf):
    return finish(profile.skewness(load(spark, sf, "lineitem"), LI_NUM))


# ---------------------------------------------------------------- A25
_IQR_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@register(
    "iqr_outliers",
    sql="WITH lv AS (" + _long_sql("lineitem", _IQR_COLS) + """),
qs AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
       FROM lv WHERE value IS NOT NULL GROUP BY "column")
SELECT lv."column", round(q1, 6) AS q1, round(q3, 6) AS q3,
       count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM lv JOIN qs ON lv."column" = qs."column" WHERE value IS NOT NULL GROUP BY lv."column", q1, q3""",
    headline=True,
)
def iqr_outliers(spark, sf):
    return finish(profile.iqr_outliers(load(spark, sf, "lineitem"), _IQR_COLS))


# ---------------------------------------------------------------- A22
def _hist_sql(table: str, value: str, bins: int, groups: list[str]) -> str:
    g = "".join(f"{x}, " for x in groups)
    return f"""WITH d AS (SELECT * FROM {table} WHERE {value} IS NOT NULL),
mm AS (SELECT min({value}) AS _min, max({value}) AS _max FROM d),
b AS (SELECT {g}_min, _max, (_max - _min) / {bins} AS width,
             CASE WHEN _max = _min THEN 0 ELSE least(CAST(floor(({value} - _min) / ((_max - _min) / {bins})) AS INTEGER), {bins - 1}) END AS bin
      FROM d, mm),
h AS (SELECT {g}bin, any_value(_min) AS _min, any_value(width) AS width, count(*) AS n FROM b GROUP BY {g}bin)"""


@register(
    "histogram",
    sql=_hist_sql("orders", "o_totalprice", 30, [])
    + "\nSELECT bin, round(_min + bin * width, 6) AS lo, round(_min + (bin + 1) * width, 6) AS hi, n FROM h",
    headline=True,
)
def histogram(spark, sf):
    return finish(profile.histogram(load(spark, sf, "orders"), "o_totalprice", 30))


# ---------------------------------------------------------------- A24
@register(
    "density_by_group",
    sql=_hist_sql("lineitem", "l_extendedprice", 25, ["l_returnflag"])
    + """, t AS (SELECT l_returnflag, sum(n) AS gn FROM h GROUP BY l_returnflag)
SELECT h.l_returnflag, bin, round(_min + bin * width, 6) AS lo, round(_min + (bin + 1) * width, 6) AS hi, n,
       round(1e6 * n / (gn * ((_min + (bin + 1) * width) - (_min + bin * width))), 6) AS density_per_million
FROM h JOIN t ON h.l_returnflag = t.l_returnflag""",
)
def density_by_group(spark, sf):
    d = profile.density_by_group(load(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", 25)
    return finish(d.withColumn("density_per_million", 1e6 * F.col("density")).drop("density"))


@register(
    "density_curve",
    sql="""WITH d AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL),
per AS (SELECT g, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * power(count(*), -0.2) AS bw FROM d GROUP BY g),
cell AS (SELECT d.g, least(floor((v - lo) / (hi - lo) * 1024), 1023) AS cell, count(*) AS c, avg(v) AS mid FROM d JOIN per USING (g) GROUP BY ALL),
point AS (SELECT g, n, bw, p::INT AS point, lo - 3 * bw + p * ((hi + 3 * bw) - (lo - 3 * bw)) / 199 AS x FROM per, unnest(range(200)) AS t(p))
SELECT g AS o_orderpriority, point, round(x, 4) AS x, round(1e6 * sum(c * exp(-power((x - mid) / bw, 2) / 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) AS density_per_million
FROM cell JOIN point USING (g) GROUP BY g, point, x""",
)
def density_curve(spark, sf):
    d = profile.density_curve(load(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return finish(d.select("o_orderpriority", "point", F.round("x", 4).alias("x"), (1e6 * F.col("density")).alias("density_per_million")))


# ---------------------------------------------------------------- A23
@register(
    "box_stats",
    sql="""WITH d AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL),
qs AS (SELECT g, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM d GROUP BY g)
SELECT d.g AS o_orderpriority, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
       round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS whisker_lo,
       max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_hi,
       count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM d JOIN qs ON d.g = qs.g GROUP BY d.g, q1, median, q3""",
    headline=True,
)
def box_stats(spark, sf):
    return finish(profile.box_stats(load(spark, sf, "orders"), "o_totalprice", "o_orderpriority"))


# ---------------------------------------------------------------- A19
@register(
    "coverage_by_grade",
    sql=fx.with_ctes(behaviour_long_sql())
    + """SELECT Grade_Level, Metric, count(DISTINCT Subject) AS n_subjects, count(Value) AS n_values,
       count(DISTINCT c_custkey) AS n_ids FROM behaviour_long GROUP BY Grade_Level, Metric""",
)
def coverage_by_grade(spark, sf):
    return profile.coverage_by_grade(behaviour_long(spark, sf), "c_custkey")


# ---------------------------------------------------------------- A28
REQUIRED_FEATURES = {
    "Overall_Avg_Attendance": ("Engagement", ["Overall_Avg_Attendance", "Attendance_Overall"]),
    "Overall_Avg_Homework": ("Engagement", ["Overall_Avg_Homework"]),
    "Overall_Avg_Participation": ("Engagement", ["Overall_Avg_Participation"]),
    "Overall_Test_Score_Avg": ("Academic", ["Overall_Test_Score_Avg", "Test_Score_Overall"]),
    "Avg_Test_Score_Secondary": ("Academic", ["Avg_Test_Score_Secondary"]),
    "Overall_Textbook_Access_Composite": ("Resources", ["Overall_Textbook_Access_Composite", "Textbook_Access"]),
    "School_Resources_Score": ("Resources", ["School_Resources_Score"]),
}


@register(
    "feature_coverage",
    sql=fx.with_ctes(stage_features_sql())
    + """, r AS (SELECT avg(CAST(Overall_Avg_Attendance IS NOT NULL AS DOUBLE)) AS a1,
                 avg(CAST(Overall_Avg_Homework IS NOT NULL AS DOUBLE)) AS a2,
                 avg(CAST(Overall_Avg_Participation IS NOT NULL AS DOUBLE)) AS a3,
                 avg(CAST(Overall_Test_Score_Avg IS NOT NULL AS DOUBLE)) AS b1,
                 avg(CAST(Avg_Test_Score_Secondary IS NOT NULL AS DOUBLE)) AS b2,
                 avg(CAST(Overall_Textbook_Access_Composite IS NOT NULL AS DOUBLE)) AS c1,
                 0.0 AS c2 FROM sfeat),
l AS (SELECT 'Engagement' AS category, a1 AS r FROM r UNION ALL SELECT 'Engagement', a2 FROM r
      UNION ALL SELECT 'Engagement', a3 FROM r UNION ALL SELECT 'Academic', b1 FROM r
      UNION ALL SELECT 'Academic', b2 FROM r UNION ALL SELECT 'Resources', c1 FROM r UNION ALL SELECT 'Resources', c2 FROM r)
SELECT category, count(*) AS n_features, round(avg(r), 6) AS mean_non_null_rate, round(min(r), 6) AS min_non_null_rate,
       count(*) FILTER (WHERE r > 0) AS n_available FROM l GROUP BY category""",
)
def feature_coverage(spark, sf):
    return finish(profile.feature_coverage(stage_features(spark, sf), REQUIRED_FEATURES))


# ---------------------------------------------------------------- D1
CORR_FEATURES = [f"Avg_{m}_{s}" for m in ("Attendance", "HW_Completion", "Participation") for s in ("Lower_Primary", "Upper_Primary", "Secondary", "Preparatory")]
CORR_TARGET = "Overall_Test_Score_Avg"


def _corr_sql_rows() -> str:
    parts = [
        f"SELECT '{f}' AS feature, corr(CASE WHEN {f} IS NOT NULL AND {CORR_TARGET} IS NOT NULL THEN {f} END, "
        f"CASE WHEN {f} IS NOT NULL AND {CORR_TARGET} IS NOT NULL THEN {CORR_TARGET} END) AS c FROM sfeat"
        for f in CORR_FEATURES
    ]
    return " UNION ALL ".join(parts)


@register(
    "corr_target",
    sql=fx.with_ctes(stage_features_sql())
    + f""", cc AS ({_corr_sql_rows()})
SELECT feature, round(c, 6) AS corr, round(abs(c), 6) AS abs_corr,
       CAST(row_number() OVER (ORDER BY abs(c) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM cc""",
)
def corr_target(spark, sf):
    return finish(stats.corr_with_target(stage_features(spark, sf), CORR_FEATURES, CORR_TARGET))


# ---------------------------------------------------------------- D2 / D3
def _pair_sql(a: str, b: str) -> str:
    return f"corr(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END)"


@register(
    "corr_matrix",
    sql=fx.with_ctes(stage_features_sql())
    + f""", cc AS ({_corr_sql_rows()}),
top AS (SELECT feature FROM cc ORDER BY abs(c) DESC NULLS LAST, feature LIMIT 5),
pairs AS ("""
    + " UNION ALL ".join(
        (f"SELECT '{a}' AS f1, '{b}' AS f2, 1.0 AS corr" if a == b else f"SELECT '{a}' AS f1, '{b}' AS f2, {_pair_sql(a, b)} AS corr FROM sfeat")
        for a in CORR_FEATURES
        for b in CORR_FEATURES
    )
    + """)
SELECT f1, f2, round(corr, 6) AS corr FROM pairs
WHERE f1 IN (SELECT feature FROM top) AND f2 IN (SELECT feature FROM top)""",
)
def corr_matrix(spark, sf):
    return finish(stats.corr_matrix(stage_features(spark, sf), CORR_FEATURES, CORR_TARGET, top_k=5))


# ---------------------------------------------------------------- D4
@register(
    "trend_line",
    sql="""SELECT l_returnflag, count(*) AS n,
       round(CASE WHEN count(*) > 1 AND count(DISTINCT l_quantity) > 1 THEN regr_slope(l_extendedprice, l_quantity) END, 6) AS slope,
       round(CASE WHEN count(*) > 1 AND count(DISTINCT l_quantity) > 1 THEN regr_intercept(l_extendedprice, l_quantity) END, 6) AS intercept,
       round(CASE WHEN count(*) > 1 AND count(DISTINCT l_quantity) > 1 THEN regr_r2(l_extendedprice, l_quantity) END, 6) AS r2,
       min(l_quantity) AS x_min, max(l_quantity) AS x_max,
       round(CASE WHEN count(*) > 1 AND count(DISTINCT l_quantity) > 1 THEN regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * min(l_quantity) END, 6) AS y_at_min,
       round(CASE WHEN count(*) > 1 AND count(DISTINCT l_quantity) > 1 THEN regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * max(l_quantity) END, 6) AS y_at_max
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY l_returnflag""",
)
def trend_line(spark, sf):
    return finish(stats.trend_line(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


# ---------------------------------------------------------------- D5
@register(
    "durbin_watson",
    sql="""WITH fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_extendedprice - (a + b * l_quantity) AS e FROM lineitem, fit),
d AS (SELECT e, lag(e) OVER (ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS ep FROM r)
SELECT count(*) AS n, round(sum(power(e - ep, 2)) / sum(power(e, 2)), 6) AS durbin_watson FROM d""",
    headline=True,
)
def durbin_watson(spark, sf):
    li = load(spark, sf, "lineitem")
    fit = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a"))
    r = li.crossJoin(F.broadcast(fit)).withColumn("e", F.col("l_extendedprice") - (F.col("a") + F.col("b") * F.col("l_quantity")))
    # (l_orderkey, l_linenumber) repeats in the fixture; rows equal on the whole
    # order key have equal residuals, so the sequence is well defined
    return finish(stats.durbin_watson(r, "e", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]))


# ---------------------------------------------------------------- E11
@register(
    "category_association",
    sql="""WITH s AS (SELECT o_orderstatus, avg(o_totalprice) AS m FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1),
p AS (SELECT o_orderpriority, avg(o_totalprice) AS m FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1),
c AS (SELECT 'o_orderstatus' AS "column", corr(s.m, o.o_totalprice) AS c FROM orders o JOIN s ON o.o_orderstatus = s.o_orderstatus
      UNION ALL
      SELECT 'o_orderpriority', corr(p.m, o.o_totalprice) FROM orders o JOIN p ON o.o_orderpriority = p.o_orderpriority)
SELECT "column", round(c, 6) AS corr, round(abs(c), 6) AS abs_corr FROM c""",
)
def category_association(spark, sf):
    return finish(stats.category_association(load(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice"))


# ---------------------------------------------------------------- A5 / A6
@register(
    "region_stats",
    sql=fx.with_ctes(fx.ORDER_PEOPLE_SQL)
    + """SELECT r_name, count(*) AS n, round(avg(o_totalprice), 6) AS mean_value FROM order_people
WHERE r_name IS NOT NULL GROUP BY r_name ORDER BY mean_value DESC""",
)
def region_stats(spark, sf):
    return finish(report.group_count_mean(fx.order_people(spark, sf), "r_name", "o_totalprice").orderBy(F.desc("mean_value")))


@register(
    "segment_means",
    sql="""SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean_value FROM customer
WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""",
)
def segment_means(spark, sf):
    return finish(report.per_key_mean(load(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "mean_value"))


# ---------------------------------------------------------------- A15
@register(
    "quick_summary",
    sql="""WITH s AS (SELECT l_quantity * 2 AS v FROM lineitem)
SELECT count(*) AS total, round(avg(v), 6) AS mean, round(median(v), 6) AS median,
       count(*) FILTER (WHERE v < 50) AS n_low, count(*) FILTER (WHERE v >= 50 AND v < 70) AS n_medium,
       count(*) FILTER (WHERE v >= 70) AS n_high,
       round(100 * count(*) FILTER (WHERE v < 50) / count(*), 6) AS pct_low,
       round(100 * count(*) FILTER (WHERE v >= 50 AND v < 70) / count(*), 6) AS pct_medium,
       round(100 * count(*) FILTER (WHERE v >= 70) / count(*), 6) AS pct_high FROM s""",
)
def quick_summary(spark, sf):
    li = load(spark, sf, "lineitem").select((F.col("l_quantity") * 2).alias("v"))
    return finish(report.quick_summary(li, "v"))


# ---------------------------------------------------------------- A10
@register(
    "quality_report",
    sql=fx.with_ctes(fx.CELLS_SQL, fx.EXAM_WIDE_SQL)
    + f"""SELECT 'customers' AS metric, CAST(count(*) AS DOUBLE) AS value FROM customer
UNION ALL SELECT 'suppliers', CAST(count(*) AS DOUBLE) FROM supplier
UNION ALL SELECT 'metric_cells', CAST(count(*) AS DOUBLE) FROM cells
UNION ALL SELECT 'exam_users', CAST(count(*) AS DOUBLE) FROM exam_wide
UNION ALL SELECT 'mean_balance', round(avg(c_acctbal), 6) FROM customer
UNION ALL SELECT 'pass_rate', round(100 * avg(CAST(coalesce(c_acctbal >= {BALANCE_MARK}, false) AS INTEGER)), 6) FROM customer""",
)
def quality_report(spark, sf):
    c = load(spark, sf, "customer")
    return finish(
        report.quality_report(
            [
                ("customers", c, F.count(F.lit(1))),
                ("suppliers", load(spark, sf, "supplier"), F.count(F.lit(1))),
                ("metric_cells", fx.cells(spark, sf), F.count(F.lit(1))),
                ("exam_users", fx.exam_wide(spark, sf), F.count(F.lit(1))),
                ("mean_balance", c, F.avg("c_acctbal")),
                ("pass_rate", c, 100 * F.avg(F.coalesce(F.col("c_acctbal") >= BALANCE_MARK, F.lit(False)).cast("int"))),
            ]
        )
    )


# ---------------------------------------------------------------- A14
@register(
    "track_report",
    sql=fx.with_ctes(fx.EXAM_WIDE_SQL)
    + """, m AS (SELECT avg(Exam_click) AS c, avg(Exam_view) AS v, avg(Exam_purchase) AS p, avg(Exam_signup) AS s,
                  avg(Exam_error) AS e FROM exam_wide)
SELECT 'Social' AS track, 'Exam_click' AS subject, round(c, 6) AS mean_value FROM m
UNION ALL SELECT 'Social', 'Exam_view', round(v, 6) FROM m
UNION ALL SELECT 'Natural', 'Exam_purchase', round(p, 6) FROM m
UNION ALL SELECT 'Natural', 'Exam_signup', round(s, 6) FROM m
UNION ALL SELECT 'Common', 'Exam_error', round(e, 6) FROM m
UNION ALL SELECT 'Social', NULL, round((0.0 + c + v) / 2, 6) FROM m
UNION ALL SELECT 'Natural', NULL, round((0.0 + p + s) / 2, 6) FROM m
UNION ALL SELECT 'Common', NULL, round((0.0 + e) / 1, 6) FROM m""",
)
def track_report(spark, sf):
    return finish(report.track_report(fx.exam_wide(spark, sf), EXAM_TRACKS))


# ---------------------------------------------------------------- A27
@register(
    "exec_summary",
    sql=fx.with_ctes(fx.ORDER_PEOPLE_SQL)
    + f""", per AS (SELECT r_name, avg(CAST(o_totalprice < {ORDER_MARK} AS DOUBLE)) AS share FROM order_people
               WHERE r_name IS NOT NULL GROUP BY r_name),
pick AS (SELECT arg_max(r_name, share) AS top_g, max(share) AS top_s, arg_min(r_name, share) AS bot_g,
                min(share) AS bot_s, count(*) AS n_groups FROM per),
sz AS (SELECT count(*) AS n_rows, avg(o_totalprice) AS mean_value FROM order_people)
SELECT 'rows' AS metric, CAST(n_rows AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS details FROM sz
UNION ALL SELECT 'mean_value', round(mean_value, 6), NULL FROM sz
UNION ALL SELECT 'groups', CAST(n_groups AS DOUBLE), NULL FROM pick
UNION ALL SELECT 'highest_risk', round(100 * top_s, 6), top_g FROM pick
UNION ALL SELECT 'lowest_risk', round(100 * bot_s, 6), bot_g FROM pick""",
)
def exec_summary(spark, sf):
    op = fx.order_people(spark, sf).withColumn("at_risk", F.col("o_totalprice") < ORDER_MARK)
    return finish(report.exec_summary(op, "r_name", "at_risk", "o_totalprice"))
