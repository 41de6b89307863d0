"""Encoder, numeric-transform and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import encode as enc
from cohortlens.operators import numeric as num
from cohortlens.operators import split as sp
from cohortlens.plans.catalog.reshape import stage_features, stage_features_sql
from cohortlens.plans import fixtures as fx
from cohortlens.plans.registry import finish, register
from cohortlens.sources.tables import load

STATUS_MAP = {"F": 0, "O": 1}
PRIORITY_ORDINAL = {"5-LOW": 0, "4-NOT SPECIFIED": 1, "3-MEDIUM": 2, "2-HIGH": 3, "1-URGENT": 4}
SEGMENT_SEVERITY = {"Household": 0, "Furniture": 1, "Automobile": 2, "Machinery": 3}
TRAIN_CUTOFF = "1999-01-01"


# ---------------------------------------------------------------- E1-E3
@register(
    "binary_ordinal_encode",
    sql="""SELECT o_orderkey,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS o_orderstatus_code,
       CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
            WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS o_orderpriority_code FROM orders""",
)
def binary_ordinal_encode(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    e = enc.map_encode(o, {"o_orderstatus": STATUS_MAP, "o_orderpriority": PRIORITY_ORDINAL}, suffix="_code")
    return e.select("o_orderkey", "o_orderstatus_code", "o_orderpriority_code")


# ---------------------------------------------------------------- E4
@register(
    "health_encode",
    sql="""SELECT c_custkey, CASE WHEN t = 'Household' THEN 0 ELSE 1 END AS c_mktsegment_Flag,
       CAST(coalesce(CASE t WHEN 'Household' THEN 0 WHEN 'Furniture' THEN 1 WHEN 'Automobile' THEN 2
                            WHEN 'Machinery' THEN 3 END, 1) AS INTEGER) AS c_mktsegment_Severity
FROM (SELECT c_custkey, upper(substr(lower(trim(c_mktsegment)), 1, 1)) || substr(lower(trim(c_mktsegment)), 2) AS t FROM customer)""",
)
def health_encode(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return enc.health_encode(c, "c_mktsegment", SEGMENT_SEVERITY, healthy="Household").drop("c_mktsegment")


# ---------------------------------------------------------------- E5
@register(
    "frequency_encode",
    sql="""WITH f AS (SELECT o_orderpriority, count(*) / sum(count(*)) OVER () AS freq FROM orders
           WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT o_orderkey, o_orderpriority, round(f.freq, 6) AS o_orderpriority_Freq FROM orders LEFT JOIN f USING (o_orderpriority)""",
)
def frequency_encode(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return finish(enc.frequency_encode(o, "o_orderpriority"))


# ---------------------------------------------------------------- E6
@register(
    "target_encode",
    sql="""WITH g AS (SELECT avg(o_totalprice) AS gm FROM orders WHERE o_totalprice IS NOT NULL),
s AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean FROM orders
      WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1)
SELECT o_orderpriority, n, round(mean, 6) AS mean, round((n * mean + 10.0 * gm) / (n + 10.0), 6) AS encoding,
       round(gm, 6) AS global_mean FROM s, g""",
)
def target_encode(spark, sf):
    return finish(enc.target_encoder(load(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


# ---------------------------------------------------------------- E7
def _kfold_sql(col: str) -> str:
    return f"""(SELECT o.o_orderkey, coalesce(
    CASE WHEN t.C - coalesce(p.c, 0) > 0 THEN (t.S - coalesce(p.s, 0.0) + 10.0 * g.gm) / (t.C - coalesce(p.c, 0) + 10.0) END,
    g.gm) AS v
  FROM orders o CROSS JOIN g
  LEFT JOIN (SELECT {col}, o_orderkey % 5 AS fold, sum(o_totalprice) AS s, count(*) AS c FROM orders
             WHERE {col} IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1, 2) p
    ON o.{col} = p.{col} AND o.o_orderkey % 5 = p.fold
  LEFT JOIN (SELECT {col}, sum(o_totalprice) AS S, count(*) AS C FROM orders
             WHERE {col} IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1) t ON o.{col} = t.{col})"""


@register(
    "kfold_target_encode",
    sql=f"""WITH g AS (SELECT avg(o_totalprice) AS gm FROM orders WHERE o_totalprice IS NOT NULL),
a AS {_kfold_sql('o_orderpriority')},
b AS {_kfold_sql('o_custkey')}
SELECT a.o_orderkey, round(a.v, 6) AS priority_te, round(b.v, 6) AS custkey_te FROM a JOIN b ON a.o_orderkey = b.o_orderkey""",
    headline=True,
)
def kfold_target_encode(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    fold = F.pmod(F.col("o_orderkey"), F.lit(5))
    o = enc.kfold_target_encode(o, ["o_orderpriority", "o_custkey"], "o_totalprice", fold, ["priority_te", "custkey_te"])
    return finish(o.select("o_orderkey", "priority_te", "custkey_te"))


# ---------------------------------------------------------------- E8
@register(
    "one_hot",
    sql="""SELECT o_orderkey,
       CAST(coalesce(o_orderstatus = 'O', false) AS INTEGER) AS o_orderstatus_O,
       CAST(coalesce(o_orderstatus = 'P', false) AS INTEGER) AS o_orderstatus_P,
       CAST(coalesce(o_orderpriority = '2-HIGH', false) AS INTEGER) AS "o_orderpriority_2-HIGH",
       CAST(coalesce(o_orderpriority = '3-MEDIUM', false) AS INTEGER) AS "o_orderpriority_3-MEDIUM",
       CAST(coalesce(o_orderpriority = '4-NOT SPECIFIED', false) AS INTEGER) AS "o_orderpriority_4-NOT SPECIFIED",
       CAST(coalesce(o_orderpriority = '5-LOW', false) AS INTEGER) AS "o_orderpriority_5-LOW" FROM orders""",
)
def one_hot(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return enc.one_hot(o, ["o_orderstatus", "o_orderpriority"])


# ---------------------------------------------------------------- E9
@register(
    "label_encode",
    sql="""SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority_Label
FROM orders""",
)
def label_encode(spark, sf):
    return enc.label_encode(load(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


# ---------------------------------------------------------------- E10
@register(
    "apply_encoder",
    sql=f"""WITH tr AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{TRAIN_CUTOFF}'),
g AS (SELECT avg(o_totalprice) AS gm FROM tr WHERE o_totalprice IS NOT NULL),
s AS (SELECT o_custkey, (count(*) * avg(o_totalprice) + 10.0 * any_value(g.gm)) / (count(*) + 10.0) AS e
      FROM tr, g WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL GROUP BY o_custkey)
SELECT o.o_orderkey, round(coalesce(s.e, g.gm), 6) AS custkey_encoded
FROM orders o CROSS JOIN g LEFT JOIN s ON o.o_custkey = s.o_custkey WHERE o.o_orderdate >= TIMESTAMP '{TRAIN_CUTOFF}'""",
)
def apply_encoder(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    train = o.where(F.col("o_orderdate") < F.lit(TRAIN_CUTOFF).cast("timestamp_ntz"))
    new = o.where(F.col("o_orderdate") >= F.lit(TRAIN_CUTOFF).cast("timestamp_ntz"))
    e = enc.target_encoder(train, "o_custkey", "o_totalprice")
    return finish(enc.apply_encoder(new, e, "o_custkey", "custkey_encoded").select("o_orderkey", "custkey_encoded"))


# ---------------------------------------------------------------- T1
@register(
    "standardize",
    sql="""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp,
                  stddev_pop(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity,
       round((l_extendedprice - mp) / sp, 6) AS l_extendedprice FROM lineitem, s""",
)
def standardize(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return finish(num.standardize(li, ["l_quantity", "l_extendedprice"]))


# ---------------------------------------------------------------- T2
@register(
    "winsorize",
    sql=f"""WITH tr AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS r, count(*) OVER () AS n
            FROM orders WHERE o_orderdate < TIMESTAMP '{TRAIN_CUTOFF}' AND o_totalprice IS NOT NULL),
lim AS (SELECT max(CASE WHEN r = floor(n * 0.005) THEN v END) AS lo,
               max(CASE WHEN r = n - floor(n * 0.005) - 1 THEN v END) AS hi FROM tr)
SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '{TRAIN_CUTOFF}' THEN 'train' ELSE 'test' END AS split,
       greatest(lo, least(hi, o_totalprice)) AS o_totalprice FROM orders, lim""",
)
def winsorize(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    o = o.withColumn("split", F.when(F.col("o_orderdate") < F.lit(TRAIN_CUTOFF).cast("timestamp_ntz"), "train").otherwise("test"))
    lim = num.winsor_limits(o.where(F.col("split") == "train"), "o_totalprice")
    return num.winsorize(o, "o_totalprice", lim).select("o_orderkey", "split", "o_totalprice")


# ---------------------------------------------------------------- T3 / T4
_LOG_COLS = ["l_extendedprice", "l_quantity", "l_discount"]


@register(
    "log_skewed",
    sql=f"""WITH tr AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{TRAIN_CUTOFF}'),
sk AS (SELECT skewness(l_extendedprice) AS s1, skewness(l_quantity) AS s2, skewness(l_discount) AS s3 FROM tr)
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN abs(s1) > 0.25 THEN ln(1 + l_extendedprice) ELSE l_extendedprice END, 6) AS l_extendedprice,
       round(CASE WHEN abs(s2) > 0.25 THEN ln(1 + l_quantity) ELSE l_quantity END, 6) AS l_quantity,
       round(CASE WHEN abs(s3) > 0.25 THEN ln(1 + l_discount) ELSE l_discount END, 6) AS l_discount FROM lineitem, sk""",
)
def log_skewed(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", *_LOG_COLS)
    train = li.where(F.col("l_shipdate") < F.lit(TRAIN_CUTOFF).cast("timestamp_ntz"))
    out = num.log_skewed(li, _LOG_COLS, fit=train, threshold=0.25)
    return finish(out.select("l_orderkey", "l_linenumber", *_LOG_COLS))


# ---------------------------------------------------------------- T5
@register(
    "yeo_johnson",
    sql="""SELECT o_orderkey, round(CASE WHEN x >= 0 THEN (power(x + 1, 0.5) - 1) / 0.5
                          ELSE -(power(-x + 1, 1.5) - 1) / 1.5 END, 6) AS yj
FROM (SELECT o_orderkey, o_totalprice / 100000 - 1 AS x FROM orders)""",
)
def yeo_johnson(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000 - 1).alias("x"))
    return finish(num.yeo_johnson(o, "x", 0.5, out="yj").select("o_orderkey", "yj"))


@register("yeo_johnson_fit")
def yeo_johnson_fit(spark, sf):
    """λ by maximum likelihood (searched over a few passes), then the standardised transform."""
    o = load(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000 - 1).alias("x"))
    lam = num.yeo_johnson_fit(o, "x")
    return finish(num.yeo_johnson(o, "x", lam, out="yj", standardize_out=True).select("o_orderkey", "yj"))


_YJ_GRID = [i / 4 for i in range(-8, 13)]


@register(
    "yeo_johnson_profile",
    sql=f"""WITH t AS (SELECT o_totalprice / 100000 - 1 AS x, unnest({_YJ_GRID}::DOUBLE[]) AS lam FROM orders),
y AS (SELECT lam, x, CASE WHEN x >= 0 THEN CASE WHEN lam = 0 THEN ln(x + 1) ELSE (power(x + 1, lam) - 1) / lam END
  ELSE CASE WHEN lam = 2 THEN -ln(1 - x) ELSE -(power(1 - x, 2 - lam) - 1) / (2 - lam) END END AS y FROM t)
SELECT lam AS "lambda", round(-count(*) / 2.0 * ln(var_pop(y)) + (lam - 1) * sum(sign(x) * ln(1 + abs(x))), 3) AS log_likelihood
FROM y GROUP BY lam""",
)
def yeo_johnson_profile(spark, sf):
    """Log-likelihood of a fixed λ grid."""
    o = load(spark, sf, "orders").select((F.col("o_totalprice") / 100000 - 1).alias("x"))
    return finish(num.yeo_johnson_profile(o, "x", _YJ_GRID), 3)


# ---------------------------------------------------------------- T6
@register(
    "minmax",
    sql="""WITH m AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders)
SELECT o_orderkey, round(0.0 + 100.0 * (o_totalprice - mn) / nullif(mx - mn, 0.0), 6) AS scaled FROM orders, m""",
)
def minmax(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return finish(num.minmax_scale(o, "o_totalprice", "scaled").select("o_orderkey", "scaled"))


# ---------------------------------------------------------------- T7-T9
def _fallback_sql(short: bool) -> str:
    a = "coalesce(Overall_Avg_Attendance, 75.0)"
    h = "coalesce(Overall_Avg_Homework, 65.0)"
    p = "coalesce(Overall_Avg_Participation, 70.0)"
    r = "coalesce(c_acctbal / 10000, 0.5)"
    t = "coalesce(Overall_Textbook_Access_Composite, 0.5)"
    eng = f"(({a} * 0.4 + {h} * 0.3 + {p} * 0.3) / 100)"
    s = f"(60.4 * {r} + 17.9 * {eng} + 7.14 * {t} + 2.87 * {a} / 100"
    if not short:
        s += f" + 2.02 * 40.0 / 100 + 1.72 * {h} / 100 + 0.85 * {p} / 100"
    s += ")"
    return f"greatest(0.0, least(100.0, {s} * 0.8 + 20.0))"


@register(
    "score_fallback",
    sql=fx.with_ctes(stage_features_sql())
    + f""", base AS (SELECT s.*, c.c_acctbal FROM sfeat s JOIN customer c ON s.c_custkey = c.c_custkey),
sc AS (SELECT c_custkey, {_fallback_sql(False)} AS score, {_fallback_sql(True)} AS score_short FROM base)
SELECT c_custkey, round(score, 6) AS score, round(1.0 / (1.0 + exp(-0.15 * (50.0 - score))), 6) AS risk,
       round(score_short, 6) AS score_short FROM sc""",
)
def score_fallback(spark, sf):
    f = stage_features(spark, sf).withColumn("resources", F.col("c_acctbal") / 10000)
    roles = {
        "attendance": "Overall_Avg_Attendance",
        "homework": "Overall_Avg_Homework",
        "participation": "Overall_Avg_Participation",
        "resources": "resources",
        "textbook": "Overall_Textbook_Access_Composite",
    }
    score, risk = num.fallback_score(roles)
    short, _ = num.fallback_score(roles, short=True)
    return finish(f.select("c_custkey", score.alias("score"), risk.alias("risk"), short.alias("score_short")))


# ---------------------------------------------------------------- T10
FEATURE_ORDER = ["Overall_Avg_Attendance", "Teacher_Student_Ratio", "Overall_Avg_Homework", "Avg_Test_Score_Secondary"]


@register(
    "align_features",
    sql=fx.with_ctes(stage_features_sql())
    + """SELECT c_custkey, round(Overall_Avg_Attendance, 6) AS Overall_Avg_Attendance, CAST(40.0 AS DOUBLE) AS Teacher_Student_Ratio,
       round(Overall_Avg_Homework, 6) AS Overall_Avg_Homework, round(Avg_Test_Score_Secondary, 6) AS Avg_Test_Score_Secondary
FROM sfeat""",
)
def align_features(spark, sf):
    f = stage_features(spark, sf)
    return finish(num.align_features(f, FEATURE_ORDER, {"Teacher_Student_Ratio": 40.0}, keep=["c_custkey"]))


# ---------------------------------------------------------------- M1
@register(
    "hash_split",
    sql="""SELECT o_orderkey, CASE WHEN (o_orderkey * 7) % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def hash_split(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey")
    return sp.hash_split(o, "o_orderkey", 0.2, bucket=F.pmod(F.col("o_orderkey") * 7, F.lit(100)))


# ---------------------------------------------------------------- M2
@register(
    "stratified_split",
    sql="""SELECT o_orderkey, o_orderstatus,
       CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_orderkey * 7) % 1000003, o_orderkey) - 1
                 < ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) THEN 'test' ELSE 'train' END AS split
FROM orders""",
)
def stratified_split(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    o = o.withColumn("_h", F.pmod(F.col("o_orderkey") * 7, F.lit(1000003)))
    return sp.stratified_split(o, "o_orderstatus", ["_h", "o_orderkey"], 0.2).select("o_orderkey", "o_orderstatus", "split")


# ---------------------------------------------------------------- M3
@register("kfold_assign", sql="SELECT o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS fold FROM orders")
def kfold_assign(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey")
    return sp.kfold(o, "o_orderkey", 5, bucket=F.pmod(F.col("o_orderkey"), F.lit(5)))


# ---------------------------------------------------------------- M4
@register(
    "sample_n",
    sql="""SELECT o_orderkey, o_totalprice FROM orders ORDER BY (o_orderkey * 7919) % 10007, o_orderkey LIMIT 100""",
)
def sample_n(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sp.sample_n(o, "o_orderkey", 100, order=F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)))
