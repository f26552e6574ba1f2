"""Chat formatting: a minimum-cost repair of turn roles, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation from a user turn to an
assistant turn.  Dynamic programming over this automaton's states chooses for each turn to keep it, to merge it into the
one before, to relabel it, or to insert an empty turn before it.  Costs form a (min, +) semiring, so a conversation that
is dealt over several partitions is solved by multiplying its segments' matrices: no task holds a whole one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # states: the role of the last turn so far
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs of repairs. An unknown role has to be relabelled, but costs less than to overrule a known one.
MERGE, INSERT, RELABEL, RELABEL_UNKNOWN = 1, 2, 3, 1
#: Ties between equal costs go by a hash of the turn, below the costs' unit: the cheapest repair is one, however turns are dealt out.
UNIT = 1 << 64
NEVER = UNIT << 128
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

SCHEMA = "conv_id long, turn long, seq int, role string, action string, cost int, rendered string"


def _moves() -> dict[tuple[int, int | None], list[tuple[int, tuple[int, ...], str, int]]]:
    """(state, turn's role) -> moves (new state, roles inserted before, action, cost); a role of None is unknown."""
    out = {}
    for state in range(4):
        for role in (SYSTEM, USER, ASSISTANT, None):
            moves = []
            for as_role in (SYSTEM, USER, ASSISTANT):
                relabel = 0 if role == as_role else RELABEL_UNKNOWN if role is None else RELABEL
                if as_role == state:
                    moves.append((as_role, (), "merge" if not relabel else "relabel+merge", MERGE + relabel))
                if as_role in FOLLOWS[state]:
                    moves.append((as_role, (), "keep" if not relabel else "relabel", relabel))
                else:
                    moves += [(as_role, (gap,), "keep" if not relabel else "relabel", INSERT + relabel) for gap in FOLLOWS[state] if as_role in FOLLOWS[gap]]
            out[state, role] = moves
    return out


MOVES = _moves()
#: What ends a conversation in each state: the roles to insert.
ENDINGS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _role(name: str | None) -> int | None:
    return {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}.get((name or "").strip().lower())


def _noise(turn, role, text) -> int:
    return xxhash.xxh64_intdigest(f"{turn}\0{role}\0{text}".encode("utf-8", "surrogatepass")) >> 24


def _weight(noise: int, k: int, cost: int) -> int:
    return cost * UNIT + ((noise * (2 * k + 3) + k * 0x9E3779B1) & 0xFFFFFFFF)


def _step(costs: list[int], role: int | None, noise: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Least costs of the states after a turn, and for each the (state before, move)."""
    best, back = [NEVER] * 4, [(-1, -1)] * 4
    for state in range(4):
        if costs[state] < NEVER:
            for k, (after, _, _, cost) in enumerate(MOVES[state, role]):
                total = costs[state] + _weight(noise, state * 16 + k, cost)
                if total < best[after]:
                    best[after], back[after] = total, (state, k)
    return best, back


def _entry(state: int) -> list[int]:
    return [0 if s == state else NEVER for s in range(4)]


def repair(turns: list[tuple], entry: int = START, leave: int | None = None) -> list[tuple]:
    """Repair (turn, role, text) rows in order: rows (turn, seq, role, action, cost, rendered).

    entry is the state before the first row; leave the state after the last, or None where the conversation ends there.
    """
    costs, trail = _entry(entry), []
    parsed = [(_role(role), _noise(turn, role, text)) for turn, role, text in turns]
    for role, noise in parsed:
        costs, back = _step(costs, role, noise)
        trail.append(back)
    state = leave if leave is not None else min(range(4), key=lambda s: costs[s] + len(ENDINGS[s]) * INSERT * UNIT)
    chosen = []
    for t in range(len(turns) - 1, -1, -1):
        before, k = trail[t][state]
        chosen.append((before, MOVES[before, parsed[t][0]][k]))
        state = before
    out, state = [], entry
    for (turn, _, text), (before, (after, inserted, action, cost)) in zip(turns, reversed(chosen), strict=True):
        state = before
        for gap in inserted:
            out.append((turn, 0, ROLES[gap - 1], "insert", INSERT, _open(state, gap) + CLOSE))
            state = START
            cost -= INSERT
        text = (text or "").replace("<|", "< |")
        merged = action.endswith("merge")
        out.append((turn, 1, ROLES[after - 1], action, cost, "\n\n" + text if merged else _open(state, after) + text))
        state = after
    if leave is None and turns:
        rendered, last = CLOSE if state != START else "", out[-1]
        out[-1] = (*last[:5], last[5] + rendered)
        out += [(turns[-1][0], 2 + i, ROLES[gap - 1], "insert", INSERT, f"{OPEN}{ROLES[gap - 1]}\n{CLOSE}") for i, gap in enumerate(ENDINGS[state])]
    return out


def _open(state: int, role: int) -> str:
    return ("" if state == START else CLOSE) + f"{OPEN}{ROLES[role - 1]}\n"


def _matrices(batches):
    """(conv_id, seg, matrix of least costs between states) of conversations that lie in several segments."""
    now, rows, out = None, [_entry(s) for s in range(4)], []
    for batch in batches:
        for conv, seg, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and now != (conv, seg):
                out.append((*now, rows))
                rows = [_entry(s) for s in range(4)]
            now = (conv, seg)
            parsed, noise = _role(role), _noise(turn, role, text)
            rows = [_step(r, parsed, noise)[0] for r in rows]
    if now is not None:
        out.append((*now, rows))
    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([[str(c) for r in o[2] for c in r] for o in out], pa.list_(pa.string()))], names=["conv_id", "seg", "costs"])


def _states(table: pa.Table) -> pa.Table:
    """The states before and after each segment of a conversation; as many rows as it has segments."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
    costs, backs = _entry(START), []
    for r in rows:
        m = np.array([int(c) for c in r["costs"]], dtype=object).reshape(4, 4)
        through = [[costs[i] + m[i][j] for i in range(4)] for j in range(4)]
        backs.append([min(range(4), key=lambda i: through[j][i]) for j in range(4)])
        costs = [min(*t, NEVER) for t in through]
    state = min(range(4), key=lambda s: costs[s] + len(ENDINGS[s]) * INSERT * UNIT)
    entry, leave = [], []
    for k in range(len(rows) - 1, -1, -1):
        leave.append(None if k == len(rows) - 1 else state)
        state = backs[k][state]
        entry.append(state)
    return pa.table({"conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "seg": pa.array([r["seg"] for r in rows], pa.int32()), "entry": pa.array(entry[::-1], pa.int32()), "leave": pa.array(leave[::-1], pa.int32())})


def _repaired(batches):
    now, turns, state, out = None, [], (None, None), []

    def flush():
        out.extend((now, *row) for row in repair(turns, START if state[0] is None else state[0], state[1]))

    started = False
    for batch in batches:
        for conv, turn, role, text, entry, leave in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if started and conv != now:
                flush()
                turns = []
            now, state, started = conv, (entry, leave), True
            turns.append((turn, role, text))
        yield _rows(out)
        out = []
    if started:
        flush()
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "seq": pa.int32(), "role": pa.string(), "action": pa.string(), "cost": pa.int32(), "rendered": pa.string()}
    columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Repair and render conversations (conv_id, turn, role, text), a row for each turn and each inserted turn.

    Returns conv_id, turn, seq (0 and from 2 on: turns inserted before and at the end), role, action (keep, merge,
    relabel, relabel+merge, insert), cost and rendered: in order of (turn, seq) the pieces of a conversation join to its
    whole text, so that no row holds more than one turn.  Turns with the same number follow by role and text.

    A null or unknown role is relabelled; a null text is empty; a null turn comes first; rows without conv_id form one
    conversation.  Repeated turns are turns like any (mostly merged).  Control signs in texts ("<|") are broken up.
    Other columns are ignored.  Empty in, empty out.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"), "text")
    # Written down, so that both passes see the same segments, whatever is recomputed.
    dealt = checkpoint(dealt.withColumn("seg", F.spark_partition_id()))
    # Two conversations at most begin or end inside each segment, so these frames have two rows for a partition at most.
    spanning = dealt.groupBy("conv_id").agg(F.min("seg").alias("a"), F.max("seg").alias("b")).filter("a < b").select(F.col("conv_id").alias("c"))
    parts = dealt.join(F.broadcast(spanning), F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "seg", "turn", "role", "text")
    matrices = parts.mapInArrow(_matrices, "conv_id long, seg int, costs array<string>")
    states = matrices.groupBy("conv_id").applyInArrow(_states, "conv_id long, seg int, entry int, leave int").select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), "entry", "leave")
    known = dealt.join(F.broadcast(states), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s")), "left")
    return known.select("conv_id", "turn", "role", "text", "entry", "leave").mapInArrow(_repaired, SCHEMA)
