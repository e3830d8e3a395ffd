"""Chat formatting by minimum-cost role repair.

A legal conversation is: an optional system turn, then user and assistant in turn, ending with the assistant. Each given turn
keeps its role or is relabelled, and either opens a turn (where needed after inserted empty turns) or is merged into the turn
before it; at the end empty turns complete the conversation. Dynamic programming over the automaton's states (the role that
came last) finds the cheapest repair; ties prefer, in this order, keep, merge, insert, relabel, and the earlier role.

The cost of a stretch of turns is a matrix (state before, state after), and stretches compose by (min, +). So a conversation
of any length is repaired in parts: the turns are range-partitioned by conversation and turn; conversations that lie within a
part are solved there; of one that crosses parts, each part sends its matrix (16 numbers, at most two for each part, to the
driver), then, given the costs in front of it, which state each last state came from; so the states at the crossings are
those of an undivided run, and every part finds its own turns' repair between them. No task holds a whole hot conversation.

Result: a row for each given turn and each inserted one: conv_id, turn, slot (0: inserted before the turn, 1: the turn, 2:
inserted at the end), role, action, rendered, seq. Joined in the order of seq (whose order alone means anything), `rendered`
is the conversation in ChatML; `render` does that for conversations that fit in a row.

Defined results: role names are trimmed and lower-cased, with a few other names known; null and unknown roles take any role
at a lower cost; null text is an empty turn; rows of a null conv_id are one conversation, first in order; null turns come
first in theirs; equal turn numbers are ordered by role and text, repeated rows stand beside each other; marks of the format
within a text are broken by a space; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialize, partitions

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Costs.
MERGE, INSERT, RELABEL, RELABEL_UNKNOWN = 2, 5, 4, 1
FAR = 1 << 40
#: The turns that may come next, and the empty turns that lead from one state to another.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _bridges() -> dict[tuple[int, int], tuple[int, ...]]:
    """For (state, role): the fewest empty turns after which a turn of the role is legal."""
    out = {}
    for state in range(4):
        queue = [(state, ())]
        while queue:
            at, made = queue.pop(0)
            for role in NEXT[at]:
                out.setdefault((state, role), made)
                if len(made) < 2 and role != SYSTEM:
                    queue.append((role, (*made, role)))
    return out


BRIDGES = _bridges()
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_of(name: str | None) -> int:
    """START stands for an unknown role."""
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else START


def _moves(role: int) -> list[list[tuple[int, int, str, tuple[int, ...]]]]:
    """For each state before: (state after, cost, action, inserted turns), in the order of preference."""
    out = []
    for state in range(4):
        found = []
        for to in (SYSTEM, USER, ASSISTANT):
            relabel = 0 if to == role else RELABEL_UNKNOWN if role == START else RELABEL
            mark = "relabel" if relabel else ""
            if (state, to) in BRIDGES:
                made = BRIDGES[state, to]
                found.append((to, relabel + INSERT * len(made), "+".join(x for x in (mark, "insert" if made else "") if x) or "keep", made))
            if state == to:
                found.append((to, relabel + MERGE, "+".join(x for x in (mark, "merge") if x), ()))
        rank = {"keep": 0, "merge": 1, "insert": 2}
        out.append(sorted(found, key=lambda m: (m[1], rank.get(m[2], 3), m[0])))
    return out


MOVES = [_moves(role) for role in range(4)]
STEP = [[[min((m[1] for m in MOVES[r][s] if m[0] == t), default=FAR) for t in range(4)] for s in range(4)] for r in range(4)]


def compose(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[min(a[s][k] + b[k][t] for k in range(4)) for t in range(4)] for s in range(4)]


def matrix(roles: list[int]) -> list[list[int]]:
    out = [[0 if s == t else FAR for t in range(4)] for s in range(4)]
    for r in roles:
        out = compose(out, STEP[r])
    return out


def origins(roles: list[int], before: list[int]) -> list[int]:
    """For each state after the turns, the state in front of them from which the repair comes, given the costs there."""
    cost, origin = list(before), list(range(4))
    for r in roles:
        new, of = [FAR] * 4, [0] * 4
        for state in range(4):
            for to in range(4):
                if cost[state] + STEP[r][state][to] < new[to]:
                    new[to], of[to] = cost[state] + STEP[r][state][to], origin[state]
        cost, origin = new, of
    return origin


def end_cost(state: int) -> int:
    return INSERT * len(ENDING[state])


def repair(roles: list[int], entry: int = START, leave: int | None = None) -> tuple[list[tuple[int, str, tuple[int, ...]]], int, int]:
    """(role, action, inserted before) of each turn, the state after them, and the cost; `leave` fixes that state."""
    cost = [FAR] * 4
    cost[entry] = 0
    back = []
    for r in roles:
        new, how = [FAR] * 4, [None] * 4
        for state in range(4):
            if cost[state] < FAR:
                for to, c, action, made in MOVES[r][state]:
                    if cost[state] + c < new[to]:
                        new[to], how[to] = cost[state] + c, (state, action, made)
        cost = new
        back.append(how)
    state = leave if leave is not None else min(range(4), key=lambda s: (cost[s] + end_cost(s), s))
    total, at, out = cost[state] + (end_cost(state) if leave is None else 0), state, []
    for how in reversed(back):
        before, action, made = how[at]
        out.append((at, action, made))
        at = before
    return out[::-1], state, total


def _safe(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def rows_of(turns: list[tuple], roles: list[int], entry: int, leave: int | None) -> Iterator[tuple]:
    """Output rows of the turns (conv_id, turn, text); with `leave` None the conversation ends here."""
    plan, state, _ = repair(roles, entry, leave)
    begun, out = entry != START, []
    for (conv, turn, text), (role, action, made) in zip(turns, plan, strict=True):
        for empty in made:
            out.append([conv, turn, 0, ROLES[empty], "insert", (f"{CLOSE}\n" if begun else "") + f"{OPEN}{ROLES[empty]}\n"])
            begun = True
        opening = "\n\n" if "merge" in action else (f"{CLOSE}\n" if begun else "") + f"{OPEN}{ROLES[role]}\n"
        out.append([conv, turn, 1, ROLES[role], action.replace("+insert", "").replace("insert", "keep"), opening + _safe(text)])
        begun = True
    if leave is None:
        for empty in ENDING[state]:
            out.append([turns[-1][0], turns[-1][1], 2, ROLES[empty], "insert", f"{CLOSE}\n{OPEN}{ROLES[empty]}\n"])
        out[-1][-1] += f"{CLOSE}\n"
    yield from map(tuple, out)


RESULT = "conv_id long, turn long, slot int, role string, action string, rendered string, seq long"
MATRICES = "part int, conv_id long, edge string, costs array<long>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(part, turns as (conv_id, turn, role, text)) of neighbouring rows of one part and conversation."""
    held, at = [], None
    for batch in batches:
        for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "turn", "role", "text")), strict=True):
            if at is not None and at != (part, row[0]):
                yield at[0], held
                held = []
            at = part, row[0]
            held.append(tuple(row))
    if held:
        yield at[0], held


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], bool, bool]]:
    """The segments, and whether each is its part's first and last."""
    before, first = None, True
    for part, turns in _segments(batches):
        if before is not None:
            new = before[0] != part
            yield *before, first, new
            first = new
        before = part, turns
    if before is not None:
        yield *before, first, True


def format_chats(conversations: DataFrame) -> DataFrame:
    """RESULT of all conversations (conv_id, turn, role, text)."""
    n_parts, order = partitions(conversations), ["conv_id", "turn", "role", "text", "_row"]
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    parts = materialize(rows.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("_place")), "chats")
    parts = parts.repartitionByRange(n_parts, "part").sortWithinPartitions("part", "_place")  # a hash would heap up small integers

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, turns, first, last in _edges(batches):
            if first or last:
                costs = [c for row in matrix([role_of(t[2]) for t in turns]) for c in row]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "conv_id": pa.array([turns[0][0]], pa.int64()), "edge": ["both" if first and last else "first" if first else "last"], "costs": pa.array([costs], pa.list_(pa.int64()))})

    bare = parts.select("part", "conv_id", "turn", "role", F.lit("").alias("text"), "_place")
    chains = chains_of(bare.mapInArrow(edges, MATRICES).collect())
    costs = costs_before(chains)

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, turns in _segments(batches):
            if (before := costs.get((part, turns[0][0]))) is not None:
                found = origins([role_of(t[2]) for t in turns], before)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "conv_id": pa.array([turns[0][0]], pa.int64()), "edge": ["trace"], "costs": pa.array([found], pa.list_(pa.int64()))})

    crossing = crossings(chains, {(r.part, r.conv_id): r.costs for r in bare.mapInArrow(traces, MATRICES).collect()} if costs else {})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, at, n = [], 0, None, 0
        for part, turns in _segments(batches):
            at, n = part, n if part == at else 0
            entry, leave = crossing.get((part, turns[0][0]), (START, None))
            made = list(rows_of([(c, t, x) for c, t, _, x in turns], [role_of(r) for _, _, r, _ in turns], entry, leave))
            out += [(*r, (part << 40) + n + k) for k, r in enumerate(made)]
            n += len(made)
            size += sum(len(r[-1]) for r in made)
            if size > 4_000_000:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return parts.select("part", "conv_id", "turn", "role", "text", "_place").mapInArrow(solve, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in RESULT.split(", ")])


def chains_of(edges: list) -> list[list]:
    """The shares of each conversation that crosses parts, in order."""
    chains: list[list] = []
    for e in sorted(edges, key=lambda e: (e.part, e.edge == "last")):
        if chains and chains[-1][-1].conv_id == e.conv_id and chains[-1][-1].part != e.part and e.edge != "last":
            chains[-1].append(e)
        else:
            chains.append([e])
    return [c for c in chains if len(c) > 1]


def costs_before(chains: list[list]) -> dict[tuple[int, int | None], list[int]]:
    """Cheapest cost of each state in front of every share."""
    out = {}
    for chain in chains:
        cost = [0, FAR, FAR, FAR]
        for e in chain:
            out[e.part, e.conv_id] = cost
            cost = [min(FAR, *(cost[s] + e.costs[4 * s + t] for s in range(4))) for t in range(4)]
        out[None, chain[0].conv_id, chain[0].part] = cost
    return out


def crossings(chains: list[list], came_from: dict) -> dict[tuple[int, int | None], tuple[int, int | None]]:
    """States before and after each part's share of every conversation that crosses parts."""
    ends, out = costs_before(chains), {}
    for chain in chains:
        cost = ends[None, chain[0].conv_id, chain[0].part]
        state = min(range(4), key=lambda s: (cost[s] + end_cost(s), s))
        for k in range(len(chain) - 1, -1, -1):
            at = chain[k].part, chain[k].conv_id
            out[at] = came_from[at][state], None if k == len(chain) - 1 else state
            state = came_from[at][state]
    return out


def render(formatted: DataFrame) -> DataFrame:
    """(conv_id, text): whole conversations, for those that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "rendered")))
    return formatted.groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.array_join(F.transform("p", lambda x: x["rendered"]), "").alias("text"))
