"""Batch scoring and rule queries (L16-L21): every customer scored at once."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.functions.mathx import clip
from cohortlens.operators import models as ml
from cohortlens.operators import numeric as num
from cohortlens.operators import rules
from cohortlens.plans import fixtures as fx
from cohortlens.plans.catalog.encode import _fallback_sql
from cohortlens.plans.catalog.models import FEATURES, RISK, TARGET, gbt_classifier, gbt_regressor, score_frame
from cohortlens.plans.catalog.reshape import stage_features, stage_features_sql
from cohortlens.plans.registry import finish, register

ROLES = {
    "attendance": "Overall_Avg_Attendance",
    "homework": "Overall_Avg_Homework",
    "participation": "Overall_Avg_Participation",
    "textbook": "Overall_Textbook_Access_Composite",
    "resources": "resources",
}
SCORE_ROLES = {k: v for k, v in ROLES.items()}


def score_inputs(spark, sf):
    return stage_features(spark, sf).withColumn("resources", F.col("c_acctbal") / 10000)


def _fallback(roles):
    return num.fallback_score(roles)


# ------------------------------------------------------------------ SQL helpers
_SQL_ROLE_COL = {
    "attendance": "Overall_Avg_Attendance",
    "homework": "Overall_Avg_Homework",
    "participation": "Overall_Avg_Participation",
    "textbook": "Overall_Textbook_Access_Composite",
    "resources": "(c_acctbal / 10000)",
}


def _lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else repr(float(v))


def _role_sql(r: str) -> str:
    d = rules.ROLE_DEFAULTS[r]
    return f"coalesce({_SQL_ROLE_COL[r]}, {_lit(d)})" if r in _SQL_ROLE_COL else _lit(d)


def _test_sql(r: str, op: str, a) -> str:
    v = _role_sql(r)
    if op == "in":
        return f"{v} IN ({', '.join(_lit(x) for x in a)})"
    sym = {"lt": "<", "gt": ">", "ge": ">=", "le": "<=", "eq": "=", "ne": "<>"}[op]
    return f"{v} {sym} {_lit(a)}"


def _fired_sql(rule_list) -> str:
    return "concat_ws(' | ', " + ", ".join(f"CASE WHEN {_test_sql(r, op, a)} THEN '{t}' END" for r, op, a, t in rule_list) + ")"


BASE_SQL = fx.with_ctes(stage_features_sql()) + f""", base AS (SELECT s.*, c.c_acctbal FROM sfeat s JOIN customer c ON s.c_custkey = c.c_custkey),
sc AS (SELECT *, {_fallback_sql(False)} AS score FROM base),
scr AS (SELECT *, 1.0 / (1.0 + exp(-0.15 * (50.0 - score))) AS risk FROM sc)
"""


# ---------------------------------------------------------------- L17
@register(
    "risk_causes",
    sql=BASE_SQL
    + f"""SELECT c_custkey, CAST(risk >= 0.5 AS INTEGER) AS is_risk,
  CASE WHEN risk >= 0.5 THEN coalesce(nullif({_fired_sql(rules.RISK_FACTORS)}, ''), '{rules.AT_RISK_DEFAULT}')
       ELSE coalesce(nullif(concat_ws(' | ', """
    + ", ".join(
        f"CASE WHEN {_test_sql(r, op, a)} THEN '{rules.NOT_RISK_PREFIX}{t}' END" for r, op, a, t in rules.RISK_FACTORS
    )
    + f"""), ''), '{rules.NOT_RISK_DEFAULT}') END AS causes FROM scr""",
)
def risk_causes(spark, sf):
    d = score_inputs(spark, sf)
    _, risk = _fallback(SCORE_ROLES)
    is_risk = risk >= 0.5
    return d.select("c_custkey", is_risk.cast("int").alias("is_risk"), F.concat_ws(" | ", rules.risk_causes(ROLES, is_risk)).alias("causes"))


# ---------------------------------------------------------------- L18
@register(
    "recommendations",
    sql=BASE_SQL
    + f"""SELECT c_custkey, concat_ws(' | ',
  CASE WHEN risk > 0.5 THEN '{" | ".join(rules.REC_AT_RISK)}'
       ELSE '{rules.REC_WELL_HEAD} | Predicted Score: ' || CAST(round(score, 1) AS VARCHAR) || ' | Risk Probability: '
            || CAST(round(risk * 100, 1) AS VARCHAR) || '% | {rules.REC_WELL_TAIL}' END,
  nullif({_fired_sql(rules.RECOMMENDATIONS)}, '')) AS recommendations FROM scr""",
)
def recommendations(spark, sf):
    d = score_inputs(spark, sf)
    score, risk = _fallback(SCORE_ROLES)
    return d.select("c_custkey", F.concat_ws(" | ", rules.recommendations(ROLES, score, risk)).alias("recommendations"))


def _quoted(text: str) -> str:
    number = {"{score}": "CAST(round(score, 1) AS VARCHAR)", "{risk}": "CAST(round(risk * 100, 1) AS VARCHAR)"}
    for mark, sql in number.items():
        if mark in text:
            a, b = text.split(mark)
            return f"'{a}' || {sql} || '{b}'"
    return f"'{text}'"


_FACTORS_SQL = _fired_sql([(r, op, a, rules.BRIEF_ADDRESS.replace("{factor}", t.lower())) for r, op, a, t in rules.RISK_FACTORS])


@register(
    "recommendations_brief",
    sql=BASE_SQL
    + f"""SELECT c_custkey, CASE WHEN risk > 0.5 THEN concat_ws(' | ', '{" | ".join(rules.BRIEF_AT_RISK)}', nullif({_fired_sql(rules.BRIEF_RISK_RULES)}, ''))
  ELSE concat_ws(' | ', {", ".join(map(_quoted, rules.BRIEF_WELL))},
    CASE WHEN {_FACTORS_SQL} <> '' THEN '{rules.BRIEF_AREAS} | ' || {_FACTORS_SQL} ELSE '{rules.BRIEF_ALL_GOOD}' END) END AS recommendations FROM scr""",
)
def recommendations_brief(spark, sf):
    """The second set, from the rule table."""
    d = score_inputs(spark, sf)
    score, risk = _fallback(SCORE_ROLES)
    got = rules.evaluate_rules(d, rules.rule_table(spark), "brief", ROLES, score, risk)
    return got.select("c_custkey", F.concat_ws(" | ", "messages").alias("recommendations"))


# ---------------------------------------------------------------- L19
def _contrib_sql() -> str:
    res, att, hw, part = (_role_sql("resources"), _role_sql("attendance"), _role_sql("homework"), _role_sql("participation"))
    par, ratio, health = _role_sql("parental"), _role_sql("ratio"), _role_sql("health")
    eng = f"(({att} * 0.4 + {hw} * 0.3 + {part} * 0.3) / 100)"
    parts = {
        "c_resources": f"CASE WHEN {res} < 0.4 THEN 0.35 * (0.4 - {res}) / 0.4 WHEN {res} > 0.7 THEN -0.25 * ({res} - 0.7) / 0.3 ELSE 0.05 * (0.55 - {res}) END",
        "c_engagement": f"CASE WHEN {eng} < 0.6 THEN 0.25 * (0.6 - {eng}) / 0.6 WHEN {eng} > 0.8 THEN -0.15 * ({eng} - 0.8) / 0.2 ELSE 0.05 * (0.7 - {eng}) END",
        "c_attendance": f"CASE WHEN {att} < 80 THEN 0.12 * (80 - {att}) / 80 WHEN {att} > 90 THEN -0.08 * ({att} - 90) / 10 ELSE 0.02 * (85 - {att}) / 85 END",
        "c_parental": f"CASE WHEN {par} < 0.3 THEN 0.15 * (0.3 - {par}) / 0.3 WHEN {par} > 0.7 THEN -0.10 * ({par} - 0.7) / 0.3 ELSE 0.03 * (0.5 - {par}) END",
        "c_ratio": f"CASE WHEN {ratio} > 45 THEN 0.08 * ({ratio} - 45) / 55 WHEN {ratio} < 30 THEN -0.05 * (30 - {ratio}) / 30 ELSE 0.02 * ({ratio} - 40) / 40 END",
        "c_health": f"CASE WHEN {health} = 'No Issue' THEN -0.02 WHEN {health} IN ('Severe', 'Chronic Illness') THEN 0.18 WHEN {health} IN ('Moderate', 'Vision Issues', 'Hearing Issues') THEN 0.10 ELSE 0.05 END",
    }
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in parts.items())
    total = " + ".join(parts)
    return f"""c AS (SELECT c_custkey, {cols} FROM base)
SELECT c_custkey, {', '.join(f'round({k}, 12) AS {k}' for k in parts)},
       round(greatest(0.05, least(0.95, 0.3 + {total})), 12) AS risk_probability FROM c"""


@register("risk_contributions", sql=BASE_SQL.rstrip() + ",\n" + _contrib_sql())
def risk_contributions(spark, sf):
    d = score_inputs(spark, sf)
    c = rules.risk_contributions(ROLES)
    # the inputs carry many exact decimals; 12 keeps rounding away from decimal ties
    return finish(d.select("c_custkey", *[v.cast("double").alias(k) for k, v in c.items()]), 12)


# ---------------------------------------------------------------- L20
#: The Yes/No answer of the textbook rule: whether half of the textbooks or more are there.
TEXTBOOK_ANSWER = (
    "CASE WHEN Overall_Textbook_Access_Composite >= 0.5 THEN 'Yes' WHEN Overall_Textbook_Access_Composite < 0.5 THEN 'No' END"
)


def _improve_sql() -> str:
    items = ", ".join(
        f"CASE WHEN {_test_sql(r, op, a) if r != 'textbook_yes_no' else TEXTBOOK_ANSWER + f' = {_lit(a)}'} THEN '{t} (+{imp})' END"
        for r, op, a, t, imp in rules.IMPROVEMENTS
    )
    return f"array_to_string(list_slice(list_filter([{items}], lambda x: x IS NOT NULL), 1, {rules.MAX_IMPROVEMENTS}), ' | ')"


def _status_sql() -> str:
    return "concat_ws(' | ', " + ", ".join(
        f"'{name}: ' || CASE WHEN {_test_sql(r, op, a)} THEN 'Good' ELSE 'Needs Improvement' END" for name, r, op, a in rules.STATUS_RULES
    ) + ")"


@register(
    "improvements",
    sql=BASE_SQL + f"SELECT c_custkey, {_improve_sql()} AS improvements, {_status_sql()} AS status FROM base",
)
def improvements(spark, sf):
    """Improvement actions and factor status; the textbook rule tests a Yes/No
    answer, made from the composite share."""
    d = score_inputs(spark, sf).withColumn("textbook_answer", F.expr(TEXTBOOK_ANSWER))
    imp = rules.improvements({**ROLES, "textbook_yes_no": "textbook_answer"})
    text = F.transform(imp, lambda s: F.concat(s["action"], F.lit(" (+"), s["impact"].cast("string"), F.lit(")")))
    st = F.transform(rules.status_table(ROLES), lambda s: F.concat(s["factor"], F.lit(": "), s["status"]))
    return d.select("c_custkey", F.array_join(text, " | ").alias("improvements"), F.array_join(st, " | ").alias("status"))


# ---------------------------------------------------------------- L21
SCENARIOS = [
    ("attendance +10", 10.0, None, None),
    ("homework +10", None, 10.0, None),
    ("resources +0.2", None, None, 0.2),
    ("all three", 10.0, 10.0, 0.2),
]


@register(
    "scenario_delta",
    sql=BASE_SQL.replace(
        "sc AS (SELECT *,", "sc0 AS (SELECT *,"
    ).split("sc0 AS")[0]
    + """scen AS (SELECT * FROM (VALUES """
    + ", ".join(
        "('{0}', {1}, {2}, {3})".format(n, *("CAST(NULL AS DOUBLE)" if v is None else repr(v) for v in (a, h, r)))
        for n, a, h, r in SCENARIOS
    )
    + """) t(scenario, d_attendance, d_homework, d_resources)),
x AS (SELECT b.c_custkey, s.scenario, b.Overall_Avg_Attendance, b.Overall_Avg_Homework, b.Overall_Avg_Participation,
             b.Overall_Textbook_Access_Composite, b.c_acctbal,
             b.Overall_Avg_Attendance + coalesce(s.d_attendance, 0.0) AS a2,
             b.Overall_Avg_Homework + coalesce(s.d_homework, 0.0) AS h2,
             b.c_acctbal / 10000 + coalesce(s.d_resources, 0.0) AS r2 FROM base b CROSS JOIN scen s),
y AS (SELECT c_custkey, scenario, """
    + _fallback_sql(False)
    + " AS s0, "
    + _fallback_sql(False)
    .replace("Overall_Avg_Attendance", "a2")
    .replace("Overall_Avg_Homework", "h2")
    .replace("c_acctbal / 10000", "r2")
    + """ AS s1 FROM x)
SELECT c_custkey, scenario, round(s0, 6) AS baseline_score, round(s1, 6) AS scenario_score, round(s1 - s0, 6) AS score_delta,
       round(1.0 / (1.0 + exp(-0.15 * (50.0 - s1))) - 1.0 / (1.0 + exp(-0.15 * (50.0 - s0))), 6) AS risk_delta FROM y""",
)
def scenario_delta(spark, sf):
    d = score_inputs(spark, sf)
    scen = spark.createDataFrame(SCENARIOS, "scenario string, d_attendance double, d_homework double, d_resources double")
    return finish(rules.scenario_delta(d, scen, "c_custkey", _fallback, SCORE_ROLES))


# ---------------------------------------------------------------- L16
@register("batch_score")
def batch_score(spark, sf):
    """Trained score and risk models applied to every customer (not a sample):
    predicted score clipped to 0-100, risk probability, status, cause summary."""
    d = score_frame(spark, sf)  # customers without a target too: the stored medians stand in for absent features
    train = d.where((F.col("split") == "train") & F.col(TARGET).isNotNull())
    reg = ml.assemble_model(FEATURES, gbt_regressor(labelCol=TARGET, featuresCol="features")).fit(train)
    clf = ml.assemble_model(FEATURES, gbt_classifier(labelCol=RISK, featuresCol="features")).fit(train)
    s = reg.transform(d).select("c_custkey", *FEATURES, clip("prediction", 0.0, 100.0).alias("predicted_score"))
    j = clf.transform(s).withColumn("risk_probability", vector_to_array("probability")[1])
    is_risk = F.col("risk_probability") >= 0.5
    roles = {"attendance": "Overall_Avg_Attendance", "homework": "Overall_Avg_Homework", "participation": "Overall_Avg_Participation", "textbook": "Overall_Textbook_Access_Composite"}
    return finish(
        j.select(
            "c_custkey",
            "predicted_score",
            "risk_probability",
            F.when(is_risk, "At Risk").otherwise("Not At Risk").alias("status"),
            F.concat_ws(" | ", rules.risk_causes(roles, is_risk)).alias("summary"),
        )
    )
