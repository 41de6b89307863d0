"""Chat formatting with minimum-cost role repair.

A conversation is legal if it is an optional system turn, then user and
assistant turns in alternation, beginning with user and ending with assistant.
Dynamic programming over that automaton finds the cheapest way to make a
conversation legal: keep a turn, relabel it, merge it into the turn before, or
put empty turns in front of it.  The repaired turns are then rendered.

Repair is a shortest path through a chain of small matrices (state before x
state after, min-plus), which can be cut anywhere.  Conversations are therefore
range-partitioned by (conversation, turn); each partition reduces its run of a
conversation to one matrix, the few matrices of a conversation are multiplied,
and each run is then traced back between its known end states.  A conversation
that holds a third of all turns is spread over as many tasks as its turns are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.scratch import ship, stored

#: Costs of a relabelled turn (by how much its text is one), a merge and an empty turn.
RELABEL, MERGE, INSERT = 1.0, 0.4, 0.7
#: A system role that becomes another, or another that becomes one, costs this more.
SYSTEM_EXTRA = 0.5
#: Rendering of a turn.
OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"
ROLES = ("system", "user", "assistant")
#: Other names of the roles, lower-cased.
ALIASES = {"human": "user", "prompter": "user", "question": "user", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant", "answer": "assistant"}

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATE = {"system": _SYSTEM, "user": _USER, "assistant": _ASSISTANT}
#: Turns that may follow a state.
_NEXT = {_START: ("system", "user"), _SYSTEM: ("user",), _USER: ("assistant",), _ASSISTANT: ("user",)}
_INF = float("inf")
_N = 4


@lru_cache(maxsize=None)
def _ways_in(before: int, role: str) -> tuple[str, ...] | None:
    """Fewest empty turns after which ``role`` may follow ``before``."""
    for n in range(4):
        for extra in product(ROLES, repeat=n):
            state, legal = before, True
            for r in (*extra, role):
                legal = legal and r in _NEXT[state]
                state = _STATE[r]
            if legal:
                return extra
    return None


@lru_cache(maxsize=None)
def steps(role: str | None) -> tuple[tuple[int, int, float, str, str, tuple[str, ...]], ...]:
    """All ways to take a turn that says ``role`` (None: unknown): state before,
    state after, cost, action, new role, empty turns in front.  An unknown role
    is relabelled at the plain cost, whichever it becomes."""
    out = []
    for before in range(_N):
        for new in ROLES:
            change = 0.0 if new == role else RELABEL + (SYSTEM_EXTRA if role is not None and "system" in (new, role) else 0.0)
            label = "keep" if new == role else "relabel"
            extra = _ways_in(before, new)
            if extra is not None:
                out.append((before, _STATE[new], change + INSERT * len(extra), label, new, extra))
            if before == _STATE[new]:
                out.append((before, before, change + MERGE, "merge" if new == role else "relabel+merge", new, ()))
    return tuple(sorted(out, key=lambda s: (s[2], s[0], s[1], s[3])))


def ending(state: int) -> tuple[float, tuple[str, ...]]:
    """Cost and empty turns that end a conversation legally in ``state``."""
    extra = {_START: (), _SYSTEM: ("user", "assistant"), _USER: ("assistant",), _ASSISTANT: ()}[state]
    return INSERT * len(extra), extra


@lru_cache(maxsize=None)
def _matrix(role: str | None) -> np.ndarray:
    m = np.full((_N, _N), _INF)
    for before, after, cost, *_ in steps(role):
        m[before, after] = min(m[before, after], cost)
    return m


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return (a[:, :, None] + b[None, :, :]).min(1)


def trace(roles: list[str | None], first: int, last: int) -> list[tuple[float, str, str, tuple[str, ...]]]:
    """The cheapest steps of a run of turns between two states; of equally cheap
    ones the first in the order of ``steps``."""
    best = [np.full(_N, _INF)]
    best[0][first] = 0.0
    for r in roles:
        best.append((best[-1][:, None] + _matrix(r)).min(0))
    out, state = [], last
    for i in range(len(roles) - 1, -1, -1):
        for before, after, cost, action, new, extra in steps(roles[i]):
            if after == state and abs(best[i][before] + cost - best[i + 1][state]) < 1e-9:
                out.append((cost, action, new, extra))
                state = before
                break
    return out[::-1]


def _role(name: str | None) -> str | None:
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple[int, int], list[list]]]:
    """Runs of rows of one conversation and range in sorted rows: the two, and
    the lists of the columns."""
    now, held = None, None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in columns]
        keys = zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), strict=True)
        for i, key in enumerate(keys):
            if held is None or key != now:
                if held is not None:
                    yield now, held
                now, held = key, [[] for _ in columns]
            for h, col in zip(held, cols, strict=True):
                h.append(col[i])
    if held is not None:
        yield now, held


def _turn(role: str, text: str = "") -> str:
    return OPEN.format(role=role) + text + CLOSE


def _deal(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns in their order, cut into ranges of about equal size: ``part`` is the
    range, ``seq`` the place in it.  Stored, so that places stay as they are."""
    rows = conversations.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("tie"),  # so that equal turns can be dealt to several ranges
    ).where("conv_id IS NOT NULL")
    order = [F.col("conv_id"), *(F.col(c).asc_nulls_last() for c in ("turn", "role", "text")), F.col("tie")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            part_of, place = pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n))
            yield batch.drop_columns(["tie"]).append_column("part", part_of).append_column("seq", place)
            seq += n

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(number, "conv_id bigint, turn bigint, role string, text string, part int, seq bigint"))


def _by_range(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("part").sortWithinPartitions("part", "seq")


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of each run of a conversation in a range."""
    out: list[tuple[int, int, list[float]]] = []
    for (conv, part), (roles,) in _runs(batches, ["role"]):
        m = np.where(np.eye(_N, dtype=bool), 0.0, _INF)
        for r in roles:
            m = times(m, _matrix(_role(r)))
        out.append((conv, part, m.ravel().tolist()))
    conv, part, m = zip(*out, strict=True) if out else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int32()), pa.array(m, pa.list_(pa.float64()))], names=["conv_id", "part", "m"])


def _end_states(ms: list[np.ndarray]) -> list[int]:
    """States before, between and after the runs of a conversation on a
    cheapest way through it."""
    best = [np.full(_N, _INF)]
    best[0][_START] = 0.0
    for m in ms:
        best.append((best[-1][:, None] + m).min(0))
    state = int((best[-1] + [ending(s)[0] for s in range(_N)]).argmin())
    ends = [state]
    for i in range(len(ms) - 1, -1, -1):
        state = int((best[i] + ms[i][:, state]).argmin())
        ends.append(state)
    return ends[::-1]


def _plan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """End states of runs, from rows sorted by conversation and range: a row for
    each range a conversation spans, so few are held at a time."""
    names, now, held = ["conv_id", "part", "first", "last", "closes"], None, []
    out: list[tuple] = []

    def close() -> None:
        ends = _end_states([np.array(m, float).reshape(_N, _N) for _, m in held])
        for i, (part, _) in enumerate(held):
            out.append((now, part, ends[i], ends[i + 1], i == len(held) - 1))

    def rows() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        cols = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    for batch in batches:
        for conv, part, m in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "m")), strict=True):
            if conv != now and held:
                close()
                held = []
            now = conv
            held.append((part, m))
        if len(out) > 5000:
            yield rows()
            out.clear()
    if held:
        close()
    yield rows()


_REPAIRED = (
    "conv_id bigint, part int, seq bigint, turn bigint, role string, text string, cost double, action string, "
    "new_role string, inserted array<string>, closing array<string>, rendered string"
)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
        + [("cost", pa.float64()), ("action", pa.string()), ("new_role", pa.string())]
        + [("inserted", pa.list_(pa.string())), ("closing", pa.list_(pa.string())), ("rendered", pa.string())]
    )
    out: list[dict] = []
    for (conv, part), (seq, turn, role, text, first, last, closes) in _runs(batches, ["seq", "turn", "role", "text", "first", "last", "closes"]):
        taken = trace([_role(r) for r in role], first[0], last[0])
        for i, (cost, action, new, extra) in enumerate(taken):
            piece = text[i] or ""
            if action.endswith("merge"):
                piece = "\n\n" + piece
            else:
                begun = i > 0 or first[0] != _START
                piece = (CLOSE if begun else "") + "".join(_turn(r) for r in extra) + OPEN.format(role=new) + piece
            end: tuple[str, ...] = ()
            if closes[0] and i == len(taken) - 1:
                more, end = ending(last[0])
                cost, piece = cost + more, piece + CLOSE + "".join(_turn(r) for r in end)
            values = (conv, part, seq[i], turn[i], role[i], text[i], cost, action, new, list(extra), list(end), piece)
            out.append(dict(zip(schema.names, values, strict=True)))
        if len(out) >= 2000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema)


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per row of ``conversations``: ``conv_id, part, seq, turn, role,
    text, cost, action`` (keep, relabel, merge, relabel+merge), ``new_role,
    inserted`` (empty turns in front), ``closing`` (empty turns after the last
    row) and ``rendered``.  The rendered conversation is the ``rendered`` pieces
    of its rows in the order of part, seq.

    Turns are taken in the order of turn (nulls last), role, text; ties and
    repeated rows are turns like any other.  Null texts render as empty ones;
    null, empty and unknown roles are relabelled.  Rows with a null conversation
    are left out.  An empty table gives no rows; extra columns are ignored.
    """
    ship(conversations.sparkSession)
    dealt = _deal(conversations, conv_id, turn, role, text)
    runs = _by_range(dealt.select("conv_id", "part", "seq", "role")).mapInArrow(_reduce, "conv_id bigint, part int, m array<double>")
    sorted_runs = runs.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    plans = stored(sorted_runs.mapInArrow(_plan_runs, "conv_id bigint, part int, first int, last int, closes boolean"))
    return _by_range(dealt.join(plans, ["conv_id", "part"])).mapInArrow(_repair, _REPAIRED)


def summary(repaired: DataFrame) -> DataFrame:
    """One row per conversation: turns before and after, cost, what was done, and
    length and checksum (sum of the pieces' CRC-32) of the rendered text."""
    done = lambda a: F.sum(F.col("action").contains(a).cast("int"))
    inserted = F.sum(F.size("inserted") + F.size("closing"))
    rows = F.count(F.lit(1))
    return repaired.groupBy("conv_id").agg(
        rows.alias("turns_before"),
        (rows - done("merge") + inserted).alias("turns_after"),
        F.round(F.sum("cost"), 6).alias("cost"),
        done("relabel").alias("relabelled"),
        done("merge").alias("merged"),
        inserted.alias("inserted"),
        F.sum(F.length("rendered")).alias("chars"),
        F.sum(F.crc32("rendered")).alias("checksum"),
    )
