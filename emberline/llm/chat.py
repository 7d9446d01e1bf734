"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, the last one the assistant's. A dynamic program over that
automaton (states: start, system, user, assistant; the state is the role of the
last turn) gives each recorded turn a role, and merges it into the turn before
(MERGE), relabels it (RELABEL; UNKNOWN for a turn without a known role) or
inserts empty turns before it (INSERT each) at the least total cost. Among
plans of least cost, the one whose sequence of roles is first in the order
system, user, assistant is taken, so the result doesn't depend on how the rows
are dealt. The repaired sequence is rendered as
`<|im_start|>role\\ntext<|im_end|>\\n` for each turn.

A conversation of any length is repaired in segments of at most SEGMENT turns:
a segment is a 4 x 4 matrix of costs (min, +). Turns are range-partitioned and
sorted; a pass from the last segment to the first gives each the costs to go
behind it, every segment then knows where each entry state leads, and a pass
from the first to the last gives entry states. Both passes stream over sorted
small records with one row of state. A row of the result is a segment; the
texts of a conversation's rows, in the order of `chunk`, make up its rendering.

Defined results: rows with a null conv_id take no part; a null turn comes first;
a null text is empty; null and unknown roles are relabelled; rows that repeat a
turn follow one another in the order of role and text and are merged where that
costs least; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import folder, written

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
MERGE, RELABEL, UNKNOWN, INSERT = 2, 3, 1, 4
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
SEGMENT, SEGMENT_CHARS = 512, 1 << 20
FAR = 1 << 40


def _inserted() -> dict[tuple[int, int], tuple[int, ...] | None]:
    """The fewest turns to insert between a state and a turn of a role."""
    out = {}
    for s in range(4):
        frontier, seen = [((), s)], {s}
        for path, at in frontier:
            for t in NEXT[at]:
                out.setdefault((s, t), path)
                if t not in seen:
                    seen.add(t)
                    frontier.append(((*path, t), t))
    return out


BETWEEN = _inserted()
CLOSING = [BETWEEN[s, ASSISTANT] + (ASSISTANT,) if s != ASSISTANT else () for s in range(4)]


def step_cost(role: int | None, s: int, t: int) -> tuple[int, bool]:
    """Cost of a turn of this role becoming t (in state s before), and whether it merges."""
    change = 0 if role == t else RELABEL if role else UNKNOWN
    ways = [(MERGE + change, True)] if s == t else []
    if (s, t) in BETWEEN:
        ways.append((INSERT * len(BETWEEN[s, t]) + change, False))
    return min(ways, default=(FAR, False))


STEPS = {role: np.array([[step_cost(role, s, t)[0] for t in range(4)] for s in range(4)], dtype=np.int64) for role in (None, 1, 2, 3)}
for _m in STEPS.values():
    _m[:, START] = FAR
END_COSTS = np.array([0, *(INSERT * len(CLOSING[s]) for s in (1, 2, 3))], dtype=np.int64)


def role_of(name: str | None) -> int | None:
    return ALIASES.get((name or "").strip().lower())


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def to_go(roles: list[int | None], after: np.ndarray) -> list[np.ndarray]:
    """The least cost from each state before each turn on, and after the last."""
    out = [after]
    for role in reversed(roles):
        out.append(np.minimum((STEPS[role] + out[-1][None, :]).min(axis=1), FAR))
    return out[::-1]


def walk(roles: list[int | None], state: int, costs: list[np.ndarray]) -> list[int]:
    """The states after each turn."""
    out = []
    for k, role in enumerate(roles):
        state = int(np.argmin(STEPS[role][state] + costs[k + 1]))
        out.append(state)
    return out


def render(roles: list[int | None], texts: list[str], entry: int, costs: list[np.ndarray], last: bool) -> tuple[str, int, int, int, int]:
    """The segment's text, its cost, and how many turns were merged, relabelled and inserted."""
    out, cost, merged, changed, added, state = [], 0, 0, 0, 0, entry
    turn = lambda s: ("<|im_end|>\n" if s != START else "")
    for role, text, t in zip(roles, texts, walk(roles, entry, costs)):
        price, joins = step_cost(role, state, t)
        cost += price
        changed += role != t
        if joins:
            merged += 1
            out.append(("\n" if text else "") + text)
        else:
            for x in BETWEEN[state, t]:
                out.append(f"{turn(state)}<|im_start|>{NAMES[x]}\n")
                state, added = x, added + 1
            out.append(f"{turn(state)}<|im_start|>{NAMES[t]}\n{text}")
        state = t
    if last:
        for x in CLOSING[state]:
            out.append(f"{turn(state)}<|im_start|>{NAMES[x]}\n")
            state, added, cost = x, added + 1, cost + INSERT
        out.append(turn(state))
    return "".join(out), cost, merged, changed, added


def _segments(df: DataFrame, segment: int) -> DataFrame:
    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("conv_id").isNotNull())
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "text"]
    dealt = turns.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, conv, roles, texts, held, seq = [], None, [], [], 0, TaskContext.get().partitionId() << 32

        def close() -> None:
            nonlocal roles, texts, held, seq
            m = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
            for r in roles:
                m = product(m, STEPS[r])
            rows.append((conv, seq, [r or 0 for r in roles], texts, m.tobytes()))
            roles, texts, held, seq = [], [], 0, seq + 1

        def out() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary()]
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", "seg", "roles", "texts", "m"])
            rows.clear()
            return batch

        for batch in batches:
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if roles and (c != conv or len(roles) >= segment or held > SEGMENT_CHARS):
                    close()
                conv = c
                roles.append(role_of(role))
                texts.append(text)
                held += len(text)
            if len(rows) > 200:
                yield out()
        if roles:
            close()
        if rows:
            yield out()

    return dealt.mapInArrow(run, "conv_id long, seg long, roles array<int>, texts array<string>, m binary")


def _pass(df: DataFrame, descending: bool, schema: str, fold) -> DataFrame:
    """Stream each conversation's records in order; fold(state or None, record) returns (what is told, state)."""
    order = F.desc("seg") if descending else F.asc("seg")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            rows = []
            for c, seg, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if c != conv:
                    conv, state = c, None
                told, state = fold(state, value)
                rows.append((c, seg, *told))
            if rows:
                yield pa.record_batch([pa.array(x) for x in zip(*rows)], names=[x.split()[0] for x in schema.split(", ")])

    return df.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, schema)


def formatted(df: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, chunk, n_turns, cost, n_merged, n_relabelled, n_inserted and text of each segment of each conversation."""
    base = folder(df.sparkSession)
    segs = written(_segments(df, segment), f"{base}/segments")

    def back(state, m):
        after = END_COSTS if state is None else state
        return (after.tobytes(), state is None), np.minimum((np.frombuffer(m, np.int64).reshape(4, 4) + after[None, :]).min(axis=1), FAR)

    behind = written(_pass(segs.select("conv_id", "seg", "m"), True, "conv_id long, seg long, after binary, last boolean", back), f"{base}/behind")
    known = lambda r: [x or None for x in r]

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exits = []
            for roles, after in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                roles = known(roles)
                costs = to_go(roles, np.frombuffer(after, np.int64))
                exits.append(bytes(walk(roles, s, costs)[-1] for s in range(4)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(exits, pa.binary())], names=["conv_id", "seg", "exits"])

    ways = segs.select("conv_id", "seg", "roles").join(behind, ["conv_id", "seg"]).select("conv_id", "seg", "roles", "after").mapInArrow(leads, "conv_id long, seg long, exits binary")

    def forth(state, exits):
        entry, chunk = state or (START, 0)
        return (entry, chunk), (exits[entry], chunk + 1)

    entries = _pass(ways, False, "conv_id long, seg long, entry long, chunk long", forth)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, roles, texts, after, last, entry, chunk in zip(*(batch.column(k).to_pylist() for k in range(7))):
                roles = known(roles)
                text, *counts = render(roles, texts, entry, to_go(roles, np.frombuffer(after, np.int64)), last)
                rows.append((conv, chunk, len(roles), *counts, text))
            if rows:
                yield pa.record_batch([pa.array(x) for x in zip(*rows)], names=["conv_id", "chunk", "n_turns", "cost", "n_merged", "n_relabelled", "n_inserted", "text"])

    joined = segs.select("conv_id", "seg", "roles", "texts").join(behind, ["conv_id", "seg"]).join(entries, ["conv_id", "seg"])
    return joined.select("conv_id", "roles", "texts", "after", "last", "entry", "chunk").mapInArrow(tell, "conv_id long, chunk long, n_turns long, cost long, n_merged long, n_relabelled long, n_inserted long, text string")
