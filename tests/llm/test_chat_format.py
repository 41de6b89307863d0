"""Role repair against a search over all repairs, and legality of what is rendered."""

import heapq
import random
import re

import pytest

from cohortlens.llm.chat_format import INSERT, MERGE, RELABEL, ROLES, SYSTEM_EXTRA, repair, steps, summary



def _cheapest(roles):
    """Least cost by a plain search over (turns taken, last turn) with single edits."""
    heap, seen = [(0.0, 0, None, False)], {}
    follows = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
    while heap:
        cost, i, last, _ = heapq.heappop(heap)
        if seen.get((i, last), 1e9) <= cost - 1e-12 or (i, last) in seen:
            continue
        seen[i, last] = cost
        if i == len(roles) and last in ("assistant", None):
            return cost
        for r in follows[last]:
            heapq.heappush(heap, (cost + INSERT, i, r, False))
        if i < len(roles):
            for r in ROLES:
                said = roles[i]
                change = 0.0 if r == said else RELABEL + (SYSTEM_EXTRA if said is not None and "system" in (said, r) else 0.0)
                if r in follows[last]:
                    heapq.heappush(heap, (cost + change, i + 1, r, False))
                if r == last:
                    heapq.heappush(heap, (cost + change + MERGE, i + 1, r, False))
    return None


def _legal(text):
    turns = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)\n<\|end\|>\n", text, re.S)
    whole = "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)
    return whole == text and re.fullmatch(r"s?(ua)+", "".join(r[0] for r, _ in turns)) is not None, turns


CASES = {
    1: ["user", "assistant"],
    2: ["system", "user", "assistant", "user"],
    3: ["assistant", "user"],
    4: ["user", "user", "assistant", "assistant"],
    5: ["system"],
    6: ["user", "system", "assistant"],
    7: [None, "Human", "AI", ""],
    8: ["assistant"] * 9,
    9: ["tool", "user", "tool", "assistant"],
    10: ["system", "system", "user", "assistant"],
}


def _rows(cases):
    return [(c, i, r, f"text {c}/{i}", 0) for c, roles in cases.items() for i, r in enumerate(roles)]


def _run(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq int")
    settings = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return sorted(repair(df).collect(), key=lambda r: (r["conv_id"], r["part"], r["seq"]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [1, 7])
def test_costs_are_least_and_results_legal(spark, parts):
    rnd = random.Random(parts)
    cases = dict(CASES)
    for c in range(100, 160):
        cases[c] = [rnd.choice(["system", "user", "user", "assistant", "assistant", None]) for _ in range(rnd.randrange(1, 14))]
    got = _run(spark, _rows(cases), parts)
    known = {"human": "user", "ai": "assistant", "tool": None, "": None}
    for c, roles in cases.items():
        mine = [r for r in got if r["conv_id"] == c]
        plain = [known.get((r or "").lower(), r) for r in roles]
        assert sum(r["cost"] for r in mine) == pytest.approx(_cheapest(plain)), (c, roles)
        legal, turns = _legal("".join(r["rendered"] for r in mine))
        assert legal, (c, roles)
        assert [t for _, body in turns for t in body.split("\n\n") if t] == [r["text"] for r in mine]


def test_long_conversation_over_many_ranges(spark):
    rnd = random.Random(1)
    roles = [rnd.choice(["user", "assistant", "system", "x"]) for _ in range(3000)]
    got = _run(spark, _rows({1: roles, 2: ["user", "assistant"]}), 9)
    mine = [r for r in got if r["conv_id"] == 1]
    assert len({r["part"] for r in mine}) > 3
    assert sum(r["cost"] for r in mine) == pytest.approx(_cheapest([r if r in ROLES else None for r in roles]))
    assert _legal("".join(r["rendered"] for r in mine))[0]


def test_edge_rows(spark):
    rows = [(1, None, "assistant", None, 0), (1, 0, "user", "q", 0), (None, 0, "user", "lost", 0)]
    rows += [(2, 0, "user", "same", 0)] * 300 + [(3, 0, "user", "x" * 100_000, 0), (4, 5, None, None, 0)]
    got = _run(spark, rows, 5)
    assert len(got) == len(rows) - 1
    one = [r for r in got if r["conv_id"] == 1]
    assert [r["new_role"] for r in one] == ["user", "assistant"] and sum(r["cost"] for r in one) == 0
    for c in (1, 2, 3, 4):
        assert _legal("".join(r["rendered"] for r in got if r["conv_id"] == c))[0]
    assert _run(spark, []) == []


def test_summary(spark, sf_small):
    conversations = spark.read.parquet(f"{sf_small}/conversations.parquet")
    got = {r["conv_id"]: r for r in summary(repair(conversations)).collect()}
    assert len(got) == conversations.select("conv_id").distinct().count()
    assert sum(r["turns_before"] for r in got.values()) == conversations.count()
    assert all(r["turns_after"] == r["turns_before"] - r["merged"] + r["inserted"] for r in got.values())
    assert steps("user")[0][2] == 0.0
