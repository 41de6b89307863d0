"""Small SQL text builders for the oracle side (row-wise means over many columns)."""

from __future__ import annotations

from collections.abc import Sequence


def q(c: str) -> str:
    return f'"{c}"'


def row_count_sql(cols: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST({q(c)} IS NOT NULL AS INTEGER)" for c in cols) + ")" if cols else "0"


def row_sum_sql(cols: Sequence[str]) -> str:
    return "(" + " + ".join(["0.0"] + [f"coalesce(CAST({q(c)} AS DOUBLE), 0.0)" for c in cols]) + ")"


def row_mean_sql(cols: Sequence[str]) -> str:
    if not cols:
        return "CAST(NULL AS DOUBLE)"
    return f"({row_sum_sql(cols)} / nullif({row_count_sql(cols)}, 0))"


def row_std_sql(cols: Sequence[str]) -> str:
    m = row_mean_sql(cols)
    ss = " + ".join(f"coalesce(power(CAST({q(c)} AS DOUBLE) - {m}, 2), 0.0)" for c in cols)
    n = row_count_sql(cols)
    return f"(CASE WHEN {n} > 1 THEN sqrt(({ss}) / ({n} - 1)) END)"


def rounded(expr: str, alias: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {q(alias)}"
