"""Rule-based scoring outputs (L16-L21) as Column expressions.

Every rule is an array of ``when`` expressions compacted to the ones that fire,
evaluated for all rows at once.  Inputs are given by *role* (``roles`` maps a
role to a column); a role without a column, or a null value, takes the
serving default, as the dashboards' ``dict.get(key, default)`` does.

FIXED VALUES: the thresholds, rule texts (emoji and markdown markers left out),
impacts and defaults below are those of the dashboards, in their order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.mathx import clip

ROLE_DEFAULTS: dict[str, object] = {
    "resources": 0.5,
    "textbook": 0.5,
    "parental": 0.5,
    "ratio": 40.0,
    "internet": "No",
    "electricity": "No",
    "father_edu": "Unknown",
    "mother_edu": "Unknown",
    "location": "Rural",
    "health": "No Issue",
    "attendance": 75.0,
    "homework": 65.0,
    "participation": 70.0,
}

# (predicate role, test, factor text)
RISK_FACTORS = [
    ("resources", "lt", 0.4, "Low School Resources Score"),
    ("textbook", "lt", 0.4, "Poor Textbook Access"),
    ("parental", "lt", 0.3, "Low Parental Involvement"),
    ("ratio", "gt", 45, "High Teacher-Student Ratio"),
    ("internet", "eq", "No", "No Internet Access at Home"),
    ("electricity", "eq", "No", "No Electricity Access"),
    ("father_edu", "in", ("Unknown", "Primary"), "Low Father Education Level"),
    ("mother_edu", "in", ("Unknown", "Primary"), "Low Mother Education Level"),
    ("location", "eq", "Rural", "Rural School Location"),
    ("health", "ne", "No Issue", "Health Issues Present"),
]
AT_RISK_DEFAULT = "Multiple academic and environmental factors contributing to risk"
NOT_RISK_PREFIX = "Potential area for improvement: "
NOT_RISK_DEFAULT = "All indicators are in favorable ranges"

REC_AT_RISK = [
    "IMMEDIATE INTERVENTION REQUIRED",
    "Schedule academic counseling session within 1 week",
    "Implement personalized learning plan",
    "Increase parent-teacher communication (weekly updates)",
]
REC_WELL_HEAD = "STUDENT IS PERFORMING WELL"
REC_WELL_TAIL = "Maintain current study habits and routines"
RECOMMENDATIONS = [
    ("resources", "lt", 0.4, "Request additional learning materials - Current school resources are below optimal level"),
    ("textbook", "lt", 0.4, "Provide access to digital textbooks - Textbook access is limited"),
    ("parental", "lt", 0.3, "Organize parent engagement workshop - Increase parental involvement"),
    ("ratio", "gt", 45, "Advocate for reduced class size - Current ratio may limit individual attention"),
    ("attendance", "lt", 80, "Implement attendance improvement program - Target 90%+ attendance"),
    ("homework", "lt", 60, "Provide homework support and tutoring - Homework completion needs improvement"),
    ("participation", "lt", 65, "Encourage class participation - Active participation improves learning"),
]

# The brief set of the second dashboard.
BRIEF_AT_RISK = [
    "Immediate Intervention Required",
    "Schedule academic counseling session",
    "Implement personalized learning plan",
    "Increase parent-teacher communication",
]
BRIEF_RISK_RULES = [
    ("resources", "lt", 0.4, "Request additional learning materials"),
    ("textbook", "lt", 0.4, "Provide access to digital textbooks"),
    ("parental", "lt", 0.3, "Organize parent engagement workshop"),
    ("ratio", "gt", 45, "Advocate for reduced class size"),
    ("internet", "eq", "No", "Provide internet access support"),
    ("electricity", "eq", "No", "Provide Electricity access support"),
    ("health", "ne", "No Issue", "Arrange health support services"),
]
BRIEF_WELL = [
    "Student is Performing Well",
    "Predicted Overall Average: {score}",
    "Risk Probability: {risk}% (Low)",
    "Maintain current study habits",
    "Encourage participation in extracurricular activities",
]
BRIEF_AREAS = "Areas for continued improvement:"
BRIEF_ADDRESS = "Address {factor}"
BRIEF_ALL_GOOD = "All performance indicators are positive"

IMPROVEMENTS = [
    ("resources", "lt", 0.9, "Increase School Resources by 0.2", 2.5),
    ("attendance", "lt", 95, "Improve Attendance by 10%", 1.8),
    ("homework", "lt", 95, "Improve Homework by 10%", 1.2),
    ("textbook_yes_no", "eq", "No", "Provide Textbook Access", 2.0),
    ("parental", "lt", 0.8, "Increase Parental Involvement by 0.2", 1.5),
    ("ratio", "gt", 35, "Reduce Teacher-Student Ratio by 5", 1.0),
    ("participation", "lt", 85, "Improve Participation by 10%", 0.8),
]
MAX_IMPROVEMENTS = 5
STATUS_RULES = [
    ("School Resources", "resources", "ge", 0.7),
    ("Attendance", "attendance", "ge", 85),
    ("Homework", "homework", "ge", 75),
    ("Participation", "participation", "ge", 70),
    ("Teacher Ratio", "ratio", "le", 40),
]


def role(roles: Mapping[str, str], name: str, defaults: Mapping[str, object] = ROLE_DEFAULTS) -> Column:
    d = defaults.get(name)
    if name in roles:
        c = F.col(roles[name])
        return F.coalesce(c, F.lit(d)) if d is not None else c
    return F.lit(d)


def _test(v: Column, op: str, arg) -> Column:
    if op == "lt":
        return v < F.lit(arg)
    if op == "gt":
        return v > F.lit(arg)
    if op == "ge":
        return v >= F.lit(arg)
    if op == "le":
        return v <= F.lit(arg)
    if op == "eq":
        return v == F.lit(arg)
    if op == "ne":
        return v != F.lit(arg)
    if op == "in":
        return v.isin(*arg)
    raise ValueError(op)


def _fired(rules, roles) -> Column:
    return F.array_compact(F.array(*[F.when(_test(role(roles, r), op, a), F.lit(text)) for r, op, a, text in rules]))


def risk_factors(roles: Mapping[str, str]) -> Column:
    return _fired(RISK_FACTORS, roles)


def risk_causes(roles: Mapping[str, str], is_risk: Column) -> Column:
    """Factors when at risk (or the at-risk default), otherwise prefixed
    improvement areas (or the all-good default)."""
    f = risk_factors(roles)
    risky = F.when(F.size(f) > 0, f).otherwise(F.array(F.lit(AT_RISK_DEFAULT)))
    calm = F.when(F.size(f) > 0, F.transform(f, lambda x: F.concat(F.lit(NOT_RISK_PREFIX), x))).otherwise(
        F.array(F.lit(NOT_RISK_DEFAULT))
    )
    return F.when(is_risk, risky).otherwise(calm)


def _num_text(c: Column) -> Column:
    return F.round(c, 1).cast("string")


def recommendations(roles: Mapping[str, str], score: Column, risk_prob: Column, threshold: float = 0.5) -> Column:
    """Head block by risk (``> threshold``), then the threshold rules."""
    head_risk = F.array(*[F.lit(t) for t in REC_AT_RISK])
    head_ok = F.array(
        F.lit(REC_WELL_HEAD),
        F.concat(F.lit("Predicted Score: "), _num_text(score)),
        F.concat(F.lit("Risk Probability: "), _num_text(risk_prob * 100), F.lit("%")),
        F.lit(REC_WELL_TAIL),
    )
    head = F.when(risk_prob > F.lit(threshold), head_risk).otherwise(head_ok)
    return F.concat(head, _fired(RECOMMENDATIONS, roles))


RULE = "rule_set string, seq int, at_risk boolean, if_factors boolean, role string, op string, number double, texts array<string>, message string"


def rule_table(spark: SparkSession) -> DataFrame:
    """Both recommendation sets as rows: a rule applies to rows at risk or not
    (null: to all), to rows with risk factors or without (null: to all), and where
    its test on a role holds (no role: always).  ``{score}``, ``{risk}`` and
    ``{factor}`` in a message are filled in; one with ``{factor}`` is repeated for
    each factor."""
    rows: list[tuple] = []

    def add(rule_set: str, message: str, at_risk: bool | None = None, if_factors: bool | None = None, test: tuple | None = None) -> None:
        name, op, arg = test or (None, None, None)
        number = float(arg) if isinstance(arg, (int, float)) else None
        texts = [arg] if isinstance(arg, str) else list(arg) if isinstance(arg, tuple) else None
        rows.append((rule_set, len(rows), at_risk, if_factors, name, op, number, texts, message))

    for t in REC_AT_RISK:
        add("detailed", t, True)
    for t in (REC_WELL_HEAD, "Predicted Score: {score}", "Risk Probability: {risk}%", REC_WELL_TAIL):
        add("detailed", t, False)
    for name, op, arg, t in RECOMMENDATIONS:
        add("detailed", t, test=(name, op, arg))
    for t in BRIEF_AT_RISK:
        add("brief", t, True)
    for name, op, arg, t in BRIEF_RISK_RULES:
        add("brief", t, True, test=(name, op, arg))
    for t in BRIEF_WELL:
        add("brief", t, False)
    add("brief", BRIEF_AREAS, False, True)
    add("brief", BRIEF_ADDRESS, False, True)
    add("brief", BRIEF_ALL_GOOD, False, False)
    return spark.createDataFrame(rows, RULE)


def evaluate_rules(
    df: DataFrame, table: DataFrame, rule_set: str, roles: Mapping[str, str], score: Column, risk_prob: Column, threshold: float = 0.5, out: str = "messages"
) -> DataFrame:
    """``df`` with the messages of the rules of a set that hold for each row, in
    their order.  The table is data: its rules come to the rows as one small array
    (they are a fixed list), so no row is multiplied or moved."""
    fields = [c for c in table.columns if c not in ("rule_set",)]
    ordered = F.sort_array(F.collect_list(F.struct(*fields))).alias("_rules")
    rules = table.where(F.col("rule_set") == rule_set).agg(ordered)
    names = list(ROLE_DEFAULTS)
    numbers = [n for n in names if not isinstance(ROLE_DEFAULTS[n], str)]
    number_of = F.create_map(*[x for n in numbers for x in (F.lit(n), role(roles, n).cast("double"))])
    text_of = F.create_map(*[x for n in names if n not in numbers for x in (F.lit(n), role(roles, n).cast("string"))])
    d = df.crossJoin(F.broadcast(rules)).withColumns(
        {"_num": number_of, "_txt": text_of, "_factors": risk_factors(roles), "_risk": risk_prob > F.lit(threshold), "_s": _num_text(score), "_r": _num_text(risk_prob * 100)}
    )

    def holds(r: Column) -> Column:
        v, t = F.try_element_at("_num", r["role"]), F.try_element_at("_txt", r["role"])
        test = F.when(r["role"].isNull(), F.lit(True))
        for op, cond in (
            ("lt", v < r["number"]),
            ("gt", v > r["number"]),
            ("ge", v >= r["number"]),
            ("le", v <= r["number"]),
            ("eq", F.array_contains(r["texts"], t)),
            ("in", F.array_contains(r["texts"], t)),
            ("ne", ~F.array_contains(r["texts"], t)),
        ):
            test = test.when(r["op"] == op, cond)
        fits = F.coalesce(r["at_risk"] == F.col("_risk"), F.lit(True))
        some = F.coalesce(r["if_factors"] == (F.size("_factors") > 0), F.lit(True))
        return fits & some & F.coalesce(test, F.lit(False))

    def said(r: Column) -> Column:
        plain = F.replace(F.replace(r["message"], F.lit("{score}"), F.coalesce("_s", F.lit(""))), F.lit("{risk}"), F.coalesce("_r", F.lit("")))
        each = F.transform("_factors", lambda f: F.replace(plain, F.lit("{factor}"), F.lower(f)))
        return F.when(r["message"].contains("{factor}"), each).otherwise(F.array(plain))

    messages = F.flatten(F.transform(F.filter("_rules", holds), said))
    return d.withColumn(out, messages).drop("_rules", "_num", "_txt", "_factors", "_risk", "_s", "_r")


def risk_contributions(roles: Mapping[str, str], base: float = 0.3) -> dict[str, Column]:
    """Per-factor heuristic contributions and their clipped total around ``base``."""
    res = role(roles, "resources")
    att = role(roles, "attendance")
    hw = role(roles, "homework")
    part = role(roles, "participation")
    par = role(roles, "parental")
    ratio = role(roles, "ratio")
    health = role(roles, "health")
    eng = (att * 0.4 + hw * 0.3 + part * 0.3) / 100
    c = {
        "c_resources": F.when(res < 0.4, 0.35 * (0.4 - res) / 0.4).when(res > 0.7, -0.25 * (res - 0.7) / 0.3).otherwise(0.05 * (0.55 - res)),
        "c_engagement": F.when(eng < 0.6, 0.25 * (0.6 - eng) / 0.6).when(eng > 0.8, -0.15 * (eng - 0.8) / 0.2).otherwise(0.05 * (0.7 - eng)),
        "c_attendance": F.when(att < 80, 0.12 * (80 - att) / 80).when(att > 90, -0.08 * (att - 90) / 10).otherwise(0.02 * (85 - att) / 85),
        "c_parental": F.when(par < 0.3, 0.15 * (0.3 - par) / 0.3).when(par > 0.7, -0.10 * (par - 0.7) / 0.3).otherwise(0.03 * (0.5 - par)),
        "c_ratio": F.when(ratio > 45, 0.08 * (ratio - 45) / 55).when(ratio < 30, -0.05 * (30 - ratio) / 30).otherwise(0.02 * (ratio - 40) / 40),
        "c_health": F.when(health == "No Issue", F.lit(-0.02))
        .when(health.isin("Severe", "Chronic Illness"), F.lit(0.18))
        .when(health.isin("Moderate", "Vision Issues", "Hearing Issues"), F.lit(0.10))
        .otherwise(F.lit(0.05)),
    }
    total = None
    for v in c.values():
        total = v if total is None else total + v
    c["risk_probability"] = clip(F.lit(base) + total, 0.05, 0.95)
    return c


def improvements(roles: Mapping[str, str], limit: int = MAX_IMPROVEMENTS) -> Column:
    """The first ``limit`` applicable improvement actions with their
    estimated impact, in rule order."""
    arr = F.array_compact(
        F.array(
            *[
                F.when(_test(role(roles, r), op, a), F.struct(F.lit(text).alias("action"), F.lit(float(impact)).alias("impact")))
                for r, op, a, text, impact in IMPROVEMENTS
            ]
        )
    )
    return F.slice(arr, 1, limit)


def status_table(roles: Mapping[str, str]) -> Column:
    """Good / Needs Improvement per factor against the optimal values."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("factor"),
                F.when(_test(role(roles, r), op, a), F.lit("Good")).otherwise(F.lit("Needs Improvement")).alias("status"),
            )
            for name, r, op, a in STATUS_RULES
        ]
    )


def scenario_delta(df: DataFrame, scenarios: DataFrame, key: str, score_fn, roles: Mapping[str, str]) -> DataFrame:
    """Every row × every scenario.  A scenario row holds additive changes
    ``d_<role>`` (null = unchanged); ``score_fn(roles) -> (score, risk)`` is
    applied to the baseline and to the changed inputs; deltas are returned.
    The scenario table is a fixed list (broadcast, bounded by its definition)."""
    j = df.crossJoin(F.broadcast(scenarios))
    changed = {}
    for r, c in roles.items():
        dcol = f"d_{r}"
        if dcol in scenarios.columns:
            changed[f"_s_{r}"] = F.col(c) + F.coalesce(F.col(dcol), F.lit(0.0))
    j = j.withColumns(changed)
    s_roles = {r: (f"_s_{r}" if f"_s_{r}" in changed else c) for r, c in roles.items()}
    base_score, base_risk = score_fn(roles)
    new_score, new_risk = score_fn(s_roles)
    return j.select(
        key,
        "scenario",
        base_score.alias("baseline_score"),
        new_score.alias("scenario_score"),
        (new_score - base_score).alias("score_delta"),
        (new_risk - base_risk).alias("risk_delta"),
    )
