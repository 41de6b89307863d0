"""Summarise the physical plans of the headline queries (after execution, so
the AQE final plan is shown): exchanges, join strategies, aggregate kinds,
scans with their pushed filters and read schemas.  Writes markdown to stdout.

    python tools/plan_report.py [--sf DIR] [names...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.session import get_spark  # noqa: E402


def final_tree(plan: str) -> str:
    """The operator tree of the AQE final plan (the formatted output also
    prints the initial plan and per-node details)."""
    head = plan.split("\n\n")[0]
    if "== Final Plan ==" in head:
        head = head.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    return head


def summarise(plan: str) -> dict:
    tree = final_tree(plan)
    names = [m.strip() for m in re.findall(r"(?:\+- |:- |^)\*? ?([A-Za-z]+(?: [A-Za-z]+)*?)(?: \(\d+\)|$)", tree, re.M)]
    ex = re.findall(r"Arguments: (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)[^\n]*", plan)
    return {
        "exchanges": len([n for n in names if n == "Exchange"]),
        "reused": len([n for n in names if n.startswith("Reused")]),
        "partitioning": sorted(set(ex)),
        "joins": sorted({n for n in names if "Join" in n}),
        "aggregates": sorted({n for n in names if n.endswith("Aggregate")}),
        "windows": len([n for n in names if n == "Window"]),
        "scans": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)))[:4],
        "pushed": sorted({p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p})[:4],
    }


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = get_spark("local[8]")
    from cohortlens.plans.registry import HEADLINE, QUERIES, load_all

    load_all()
    print("| query | exchanges (partitioning kinds) | reused | joins | aggregates | windows | pushed filters |")
    print("|---|---|---|---|---|---|---|")
    for n in args.names or HEADLINE:
        df = QUERIES[n](spark, args.sf)
        df.write.format("noop").mode("overwrite").save()
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        s = summarise(plan)
        print(
            f"| {n} | {s['exchanges']} ({', '.join(s['partitioning'])}) | {s['reused']} | {', '.join(s['joins']) or '-'} | "
            f"{', '.join(s['aggregates']) or '-'} | {s['windows']} | {'; '.join(s['pushed']) or '-'} |"
        )


if __name__ == "__main__":
    main()
