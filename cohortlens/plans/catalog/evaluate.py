"""Evaluation and segment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import profile, report, segments, stats
from cohortlens.operators.attribution import fit_linear
from cohortlens.operators.sizing import broadcast_if_small, one_row
from cohortlens.plans import fixtures as fx
from cohortlens.plans.registry import finish, register
from cohortlens.session import materialize
from cohortlens.sources.tables import load

CHARS_MARK = 2000


def labelled_docs(spark, sf):
    """labels ⋈ documents: a 0/1 label with a continuous score (text length)."""
    lab = load(spark, sf, "labels").select("doc_id", "quality", "toxic")
    doc = load(spark, sf, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id")


LABELLED_SQL = "ld AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


# ---------------------------------------------------------------- D8
@register(
    "confusion_matrix",
    sql=fx.with_ctes(LABELLED_SQL)
    + f"""SELECT quality AS actual, CAST(n_chars >= {CHARS_MARK} AS INTEGER) AS predicted, count(*) AS n FROM ld GROUP BY 1, 2""",
)
def confusion_matrix(spark, sf):
    d = labelled_docs(spark, sf).withColumn("pred", (F.col("n_chars") >= CHARS_MARK).cast("int"))
    return stats.confusion_matrix(d, "quality", "pred")


@register(
    "classification_report",
    sql=fx.with_ctes(LABELLED_SQL)
    + f""", c AS (SELECT count(*) AS n,
    count(*) FILTER (WHERE quality = 1 AND n_chars >= {CHARS_MARK}) AS tp,
    count(*) FILTER (WHERE quality <> 1 AND n_chars >= {CHARS_MARK}) AS fp,
    count(*) FILTER (WHERE quality = 1 AND n_chars < {CHARS_MARK}) AS fn,
    count(*) FILTER (WHERE quality <> 1 AND n_chars < {CHARS_MARK}) AS tn FROM ld)
SELECT n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision,
       round(tp / nullif(tp + fn, 0), 6) AS recall,
       round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1
FROM c""",
)
def classification_report(spark, sf):
    d = labelled_docs(spark, sf).withColumn("pred", (F.col("n_chars") >= CHARS_MARK).cast("int"))
    return finish(stats.classification_report(d, "quality", "pred"))


# ---------------------------------------------------------------- D9
_PER_SCORE_SQL = """per AS (SELECT CAST(n_chars AS DOUBLE) AS score, count(*) FILTER (WHERE quality = 1) AS pos,
                  count(*) FILTER (WHERE quality <> 1) AS neg FROM ld
           WHERE n_chars IS NOT NULL AND quality IS NOT NULL GROUP BY 1)"""


@register(
    "roc_auc",
    sql=fx.with_ctes(LABELLED_SQL, _PER_SCORE_SQL)
    + """, a AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above FROM per)
SELECT round(sum(neg * (pos_above + pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM a""",
    headline=True,
)
def roc_auc(spark, sf):
    return finish(stats.roc_auc(labelled_docs(spark, sf), "quality", "n_chars"))


@register(
    "roc_points",
    sql=fx.with_ctes(LABELLED_SQL, _PER_SCORE_SQL)
    + """, c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                   sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
                   sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM per)
SELECT score, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr FROM c""",
)
def roc_points(spark, sf):
    return finish(stats.roc_points(labelled_docs(spark, sf), "quality", "n_chars"))


# ---------------------------------------------------------------- D10
@register(
    "prob_histogram",
    sql=fx.with_ctes(LABELLED_SQL)
    + """, mm AS (SELECT min(n_chars) AS _min, max(n_chars) AS _max FROM ld WHERE n_chars IS NOT NULL),
b AS (SELECT quality, _min, (_max - _min) / 10 AS width,
             CASE WHEN _max = _min THEN 0 ELSE least(CAST(floor((n_chars - _min) / ((_max - _min) / 10)) AS INTEGER), 9) END AS bin
      FROM ld, mm WHERE n_chars IS NOT NULL)
SELECT quality, bin, round(any_value(_min) + bin * any_value(width), 6) AS lo,
       round(any_value(_min) + (bin + 1) * any_value(width), 6) AS hi, count(*) AS n FROM b GROUP BY quality, bin""",
)
def prob_histogram(spark, sf):
    return finish(profile.histogram(labelled_docs(spark, sf), "n_chars", 10, ["quality"]))


# ---------------------------------------------------------------- A29
@register(
    "regression_metrics",
    sql="""WITH fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
p AS (SELECT l_returnflag, l_extendedprice AS y, a + b * l_quantity AS yhat FROM lineitem, fit
      WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL)
SELECT l_returnflag, count(*) AS n, round(1 - sum(power(y - yhat, 2)) / (var_pop(y) * count(*)), 6) AS r2,
       round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(sum(power(y - yhat, 2)) / count(*)), 6) AS rmse,
       round(100 * avg(abs(y - yhat) / nullif(abs(y), 0.0)), 6) AS mean_pct_error FROM p GROUP BY l_returnflag""",
)
def regression_metrics(spark, sf):
    li = load(spark, sf, "lineitem")
    fit = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a"))
    p = li.crossJoin(F.broadcast(fit)).withColumn("yhat", F.col("a") + F.col("b") * F.col("l_quantity"))
    return finish(stats.regression_metrics(p, "l_extendedprice", "yhat", ["l_returnflag"]))


# ---------------------------------------------------------------- D6 / J5
@register(
    "prediction_errors",
    sql="""WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS pred FROM orders GROUP BY 1)
SELECT o_orderkey, o_totalprice AS actual, round(pred, 6) AS predicted, round(o_totalprice - pred, 6) AS error,
       round(abs(o_totalprice - pred), 6) AS abs_error, round(100 * abs(o_totalprice - pred) / o_totalprice, 6) AS pct_error
FROM orders JOIN m USING (o_orderpriority)""",
)
def prediction_errors(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    m = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("predicted"))
    j = o.join(broadcast_if_small(m), "o_orderpriority")
    err = F.col("o_totalprice") - F.col("predicted")
    return finish(
        j.select(
            "o_orderkey",
            F.col("o_totalprice").alias("actual"),
            "predicted",
            err.alias("error"),
            F.abs(err).alias("abs_error"),
            (100 * F.abs(err) / F.col("o_totalprice")).alias("pct_error"),
        )
    )


# ---------------------------------------------------------------- D7
@register(
    "plot_sample",
    sql="""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS x, o_totalprice AS y FROM orders
WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL ORDER BY (o_orderkey * 7919) % 10007, o_orderkey LIMIT 500""",
)
def plot_sample(spark, sf):
    """A display sample (the limit is the feature), pairwise non-null first."""
    o = load(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("x"), F.col("o_totalprice").alias("y"))
    o = o.dropna(subset=["x", "y"])
    return o.orderBy(F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)), "o_orderkey").limit(500)


# ---------------------------------------------------------------- W1 / R7
@register(
    "cluster_share",
    sql=fx.with_ctes(fx.ORDER_PEOPLE_SQL)
    + """, c AS (SELECT r_name, o_orderstatus, count(*) AS n FROM order_people
           WHERE r_name IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2),
s AS (SELECT r_name, o_orderstatus, n / sum(n) OVER (PARTITION BY r_name) AS share FROM c)
SELECT r_name, round(coalesce(max(CASE WHEN o_orderstatus = 'F' THEN share END), 0.0), 6) AS F,
       round(coalesce(max(CASE WHEN o_orderstatus = 'O' THEN share END), 0.0), 6) AS O,
       round(coalesce(max(CASE WHEN o_orderstatus = 'P' THEN share END), 0.0), 6) AS P FROM s GROUP BY r_name""",
)
def cluster_share(spark, sf):
    return finish(segments.share_pivot(fx.order_people(spark, sf), "r_name", "o_orderstatus", ["F", "O", "P"]))


# ---------------------------------------------------------------- W2
_RANK_SQL = """rk AS (SELECT o_orderstatus, avg(o_totalprice) AS mean_value, count(*) AS n,
                  CAST(row_number() OVER (ORDER BY avg(o_totalprice) DESC, o_orderstatus) AS INTEGER) AS rank
           FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus),
lab AS (SELECT *, CASE rank WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' END AS label FROM rk)"""


@register(
    "cluster_rank_labels",
    sql=fx.with_ctes(_RANK_SQL) + "SELECT o_orderstatus, round(mean_value, 6) AS mean_value, n, rank, label FROM lab",
)
def cluster_rank_labels(spark, sf):
    return finish(segments.rank_labels(load(spark, sf, "orders"), "o_orderstatus", "o_totalprice"))


# ---------------------------------------------------------------- L12
@register(
    "regional_risk",
    sql=fx.with_ctes(fx.ORDER_PEOPLE_SQL, _RANK_SQL)
    + """SELECT r_name, count(*) AS n, round(100 * avg(CAST(coalesce(label = 'Low', false) AS DOUBLE)), 6) AS pct_label
FROM order_people op LEFT JOIN lab ON op.o_orderstatus = lab.o_orderstatus WHERE r_name IS NOT NULL GROUP BY r_name""",
)
def regional_risk(spark, sf):
    op = fx.order_people(spark, sf)
    ranked = segments.rank_labels(load(spark, sf, "orders"), "o_orderstatus", "o_totalprice")
    return finish(segments.group_label_rate(segments.label_rows(op, ranked, "o_orderstatus"), "r_name", "cluster_label"))


# ---------------------------------------------------------------- T3 / A29
@register(
    "regression_metrics_log",
    sql="""WITH x AS (SELECT l_quantity AS q, l_extendedprice AS y, ln(1 + l_extendedprice) AS ly FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
m AS (SELECT regr_slope(ly, q) AS s, regr_intercept(ly, q) AS i FROM x),
p AS (SELECT y, ly, i + s * q AS lp, y - (exp(i + s * q) - 1) AS err FROM x, m)
SELECT count(*) AS n, round(1 - sum((ly - lp) ^ 2) / (var_pop(ly) * count(*)), 2) AS r2_log, round(sqrt(avg((ly - lp) ^ 2)), 2) AS rmse_log,
       round(1 - sum(err ^ 2) / (var_pop(y) * count(*)), 2) AS r2, round(avg(abs(err)), 2) AS mae, round(sqrt(avg(err ^ 2)), 2) AS rmse,
       round(avg(err), 2) AS error_mean, round(stddev_samp(err), 2) AS error_std,
       round(quantile_cont(abs(err), 0.5), 2) AS abs_error_p50, round(quantile_cont(abs(err), 0.75), 2) AS abs_error_p75,
       round(quantile_cont(abs(err), 0.9), 2) AS abs_error_p90, round(quantile_cont(abs(err), 0.95), 2) AS abs_error_p95 FROM p""",
)
def regression_metrics_log(spark, sf):
    """A linear model of a log1p target, measured on the log and the original scale."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    li = load(spark, sf, "lineitem").select("l_quantity", "l_extendedprice").dropna()
    d = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li.withColumn("ly", F.log1p("l_extendedprice")))
    m = LinearRegression(labelCol="ly", solver="normal", regParam=0.0, predictionCol="lp").fit(d)
    return finish(stats.log_scale_metrics(m.transform(d), "l_extendedprice", "lp"), 2)


# ---------------------------------------------------------------- A27
@register(
    "summary_table",
    sql=fx.with_ctes(fx.ORDER_PEOPLE_SQL, _RANK_SQL, LABELLED_SQL, _PER_SCORE_SQL)
    + f""", reg AS (SELECT 'quantity' AS model, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem
  UNION ALL SELECT 'discount', regr_slope(l_extendedprice, l_discount), regr_intercept(l_extendedprice, l_discount) FROM lineitem),
err AS (SELECT model, l_extendedprice AS y, i + s * CASE model WHEN 'quantity' THEN l_quantity ELSE l_discount END AS p FROM lineitem, reg),
mod AS (SELECT model, 1 - sum((y - p) ** 2) / (count(*) * var_pop(y)) AS r2, avg(abs(y - p)) AS mae FROM err GROUP BY model),
top AS (SELECT * FROM mod ORDER BY r2 DESC, model LIMIT 1),
conf AS (SELECT count(*) FILTER (WHERE quality = 1 AND n_chars >= {CHARS_MARK}) AS tp, count(*) FILTER (WHERE quality <> 1 AND n_chars >= {CHARS_MARK}) AS fp,
  count(*) FILTER (WHERE quality = 1 AND n_chars < {CHARS_MARK}) AS fn FROM ld),
above AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above FROM per),
auc AS (SELECT sum(neg * (pos_above + pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM above),
rr AS (SELECT r_name, 100 * avg(CAST(coalesce(label = 'Low', false) AS DOUBLE)) AS pct FROM order_people op LEFT JOIN lab ON op.o_orderstatus = lab.o_orderstatus
  WHERE r_name IS NOT NULL GROUP BY r_name),
cl AS (SELECT label, sum(n) AS n, sum(sum(n)) OVER () AS total FROM lab GROUP BY label)
SELECT section, metric, round(value, 6) AS value, round(share, 6) AS share, name FROM (
SELECT 'dataset' AS section, 'rows' AS metric, count(*)::DOUBLE AS value, 100.0::DOUBLE AS share, NULL::VARCHAR AS name FROM orders
UNION ALL SELECT 'dataset', 'at_risk', count(*) FILTER (WHERE o_totalprice < 100000), 100.0 * count(*) FILTER (WHERE o_totalprice < 100000) / count(*), NULL FROM orders
UNION ALL SELECT 'dataset', 'mean_value', avg(o_totalprice), NULL, NULL FROM orders
UNION ALL SELECT 'clusters', lower(l), coalesce((SELECT n FROM cl WHERE label = l), 0), 100.0 * coalesce((SELECT n FROM cl WHERE label = l), 0) / (SELECT any_value(total) FROM cl), NULL
  FROM (SELECT unnest(['High', 'Medium', 'Low']) AS l)
UNION ALL SELECT 'models', 'best_r2', r2, NULL, model FROM top UNION ALL SELECT 'models', 'best_mae', mae, NULL, model FROM top
UNION ALL SELECT 'classifiers', 'best_f1', 2 * tp / (2 * tp + fp + fn), NULL, 'length' FROM conf UNION ALL SELECT 'classifiers', 'best_auc', auc, NULL, 'length' FROM auc
UNION ALL SELECT 'risk', 'highest', max(pct), NULL, arg_max(r_name, (pct, r_name)) FROM rr UNION ALL SELECT 'risk', 'lowest', min(pct), NULL, arg_min(r_name, (pct, r_name)) FROM rr)""",
)
def summary_table(spark, sf):
    """The closing table from the stored results of clustering, regression,
    classification and regional risk."""
    orders = load(spark, sf, "orders")
    ranked = materialize(segments.rank_labels(orders, "o_orderstatus", "o_totalprice"))
    risks = materialize(segments.group_label_rate(segments.label_rows(fx.order_people(spark, sf), ranked, "o_orderstatus"), "r_name", "cluster_label"))
    li = load(spark, sf, "lineitem")
    models = None
    for name in ("quantity", "discount"):
        fit = fit_linear(li, [f"l_{name}"], "l_extendedprice")
        predicted = li.withColumn("p", F.lit(fit.intercept) + F.lit(fit.coefficients[0]) * F.col(f"l_{name}"))
        part = stats.regression_metrics(predicted, "l_extendedprice", "p").select(F.lit(name).alias("model"), "r2", "mae")
        models = part if models is None else models.unionByName(part)
    docs = labelled_docs(spark, sf).withColumn("pred", (F.col("n_chars") >= CHARS_MARK).cast("int"))
    f1 = stats.classification_report(docs, "quality", "pred").select("f1")
    auc = stats.roc_auc(docs, "quality", "n_chars").select("auc")
    classifiers = materialize(f1.crossJoin(one_row(auc)).withColumn("model", F.lit("length")))
    return finish(report.summary_table(orders, "o_totalprice", 100000, ranked.select("label", "n"), materialize(models), classifiers, risks, "r_name"))
