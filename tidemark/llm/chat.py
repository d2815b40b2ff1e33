"""Chat formatting with minimum-cost role repair over a legal-turn automaton."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import cut_lineage, shuffle_partitions

#: The roles, and what may follow what. A conversation may start with a system turn, then user and assistant
#: alternate, and an assistant turn ends it.
ROLES = ("system", "user", "assistant")
SYSTEM, USER, ASSISTANT = range(3)
BEGIN = 3
LEGAL = {BEGIN: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (ASSISTANT,)
#: Costs of a repair: joining a turn to the message before it, giving it another role, putting in an empty message.
MERGE, RELABEL, INSERT = 1, 2, 3
HEAD, TAIL = "<|{}|>\n", "<|end|>\n"
NEVER = 1 << 40


def inserted(state: int, role: int) -> tuple[int, ...] | None:
    """The shortest run of empty messages that makes ``role`` legal after ``state``; None where no run does."""
    paths, seen = [(state, ())], set()
    while paths:
        nxt = []
        for s, path in paths:
            if role in LEGAL[s]:
                return path
            for r in LEGAL[s]:
                if r not in seen:
                    seen.add(r)
                    nxt.append((r, (*path, r)))
        paths = nxt
    return None


def ending(state: int) -> tuple[int, ...] | None:
    """Empty messages that make the end legal after ``state``; nothing is wrong with a conversation without turns."""
    found = [() if state in FINAL or state == BEGIN else None]
    for f in FINAL:
        path = inserted(state, f)
        found.append(None if path is None else (*path, f))
    return min((p for p in found if p is not None), key=lambda p: (len(p), p), default=None)


def moves() -> dict[tuple[int, int | None], list[tuple[int, int, bool, tuple[int, ...]]]]:
    """(state, role of a turn) to its repairs, in order of preference among equals: cost, new role, merged, inserted."""
    out = {}
    for state in range(4):
        for role in (SYSTEM, USER, ASSISTANT, None):
            found = []
            for new in sorted(range(3), key=lambda r: (r != role, r)):
                cost = RELABEL * (new != role)
                if new == state:
                    found.append((cost + MERGE, new, True, ()))
                path = inserted(state, new)
                if path is not None:
                    found.append((cost + INSERT * len(path), new, False, path))
            out[state, role] = sorted(found, key=lambda m: m[0])
    return out


MOVES = moves()
END = {s: ending(s) for s in range(4)}
END_COST = {s: NEVER if p is None else INSERT * len(p) for s, p in END.items()}


def role_of(text: str | None) -> int | None:
    name = (text or "").strip().lower()
    return ROLES.index(name) if name in ROLES else None


def costs_from(costs: list[int], roles: list[int | None]) -> list[int]:
    """Least cost of each state after the turns, given that of each state before them."""
    for role in roles:
        new = [NEVER] * 4
        for s in range(4):
            if costs[s] < NEVER:
                for cost, r, _, _ in MOVES[s, role]:
                    if costs[s] + cost < new[r]:
                        new[r] = costs[s] + cost
        costs = new
    return costs


def repair(roles: list[int | None], before: list[int] | None = None, after: list[int] | None = None) -> tuple[list[tuple[int, bool, tuple[int, ...]]], int, int]:
    """New role, merged and inserted roles for each turn; the state before the first and after the last of them.

    ``before``: cost of each state before the turns, ``after``: cost from each state to the end of the conversation.
    """
    costs = before or [NEVER, NEVER, NEVER, 0]
    back = []
    for role in roles:
        new, came = [NEVER] * 4, [None] * 4
        for s in range(4):
            if costs[s] < NEVER:
                for move in MOVES[s, role]:
                    if costs[s] + move[0] < new[move[1]]:
                        new[move[1]], came[move[1]] = costs[s] + move[0], (s, move)
        costs = new
        back.append(came)
    after = after or [END_COST[s] for s in range(4)]
    state = last = min(range(4), key=lambda s: (costs[s] + after[s], s))
    out = []
    for came in reversed(back):
        state, (_, new, merged, path) = came[state]
        out.append((new, merged, path))
    return out[::-1], state, last


def empty(role: int) -> str:
    return HEAD.format(ROLES[role]) + TAIL


def render(turns: list[tuple[int, bool, tuple[int, ...]]], texts: list[str | None], state: int, ends: bool) -> Iterator[tuple[str, str, str]]:
    """Role, action and rendered text of each turn after ``state``; together, in order, they are the conversation.

    A message stays open until a turn opens the next one or the conversation ends, so a turn needs none behind it.
    """
    for i, ((new, merged, path), text) in enumerate(zip(turns, texts, strict=True)):
        opened = "\n" if merged else TAIL * (state != BEGIN) + "".join(map(empty, path)) + HEAD.format(ROLES[new])
        closed = TAIL + "".join(map(empty, END[new] or ())) if ends and i + 1 == len(turns) else ""
        yield ROLES[new], "merge" if merged else "insert" if path else "keep", opened + (text or "") + closed
        state = new


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, place, old_role, role, action, rendered and cost of every turn of repaired conversations.

    The cheapest repair makes each conversation legal: merges join a turn to the message before it, relabels change roles
    (always those that aren't system, user or assistant, null ones among them), and empty messages go in between or at the
    end. ``rendered`` by ``place`` is the conversation's text; ``cost`` is the repair's, on each row of it. Null turns come
    first; turns of one number are ordered by a hash of role and text; repeated rows are turns of their own, null texts empty ones,
    and null conversations are one. Very long texts pass whole; other columns, whatever their names, are not read. An empty table gives none.

    Rows are range-partitioned by conversation and place, so that a long conversation goes over many tasks; these compute
    in two passes. In the first, each task gives the cost of every state to every state for the conversation that it
    shares with its neighbours; from these few numbers for each task the driver works out the states where it is cut.
    """
    spark = turns.sparkSession
    n = shuffle_partitions(spark)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("tie"), F.col("salt")]
    rows = rows.withColumns({"tie": F.xxhash64("role", "text"), "salt": F.monotonically_increasing_id()}).repartitionByRange(n, *keys)
    parts = cut_lineage(rows.sortWithinPartitions(*keys).drop("tie", "salt").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))

    def chats(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
        rows = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True))
        for conv, own in groupby(rows, key=lambda r: r[0]):
            yield conv, list(own)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the first and the last conversation of a part: cost of every state to every state."""
        part, found, n_chats, last = 0, [], 0, None
        for conv, own in chats(batches):
            part, n_chats = own[0][1], n_chats + 1
            roles = [role_of(r[2]) for r in own]
            matrix = (conv, roles)
            if n_chats == 1:
                found.append(matrix)
            last = matrix
        if n_chats > 1:
            found.append(last)
        out = [(part, n_chats, i, conv, [x for s in range(4) for x in costs_from([NEVER if q != s else 0 for q in range(4)], roles)]) for i, (conv, roles) in enumerate(found)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["part", "n", "i", "conv", "m"])

    ends = sorted(tuple(r) for r in parts.select("conv_id", "part", "role").mapInArrow(edges, "part int, n long, i int, conv long, m array<long>").collect())
    # Runs of parts that share a conversation: (part, whether it is the part's last conversation, matrix).
    shared: list[list[tuple[int, int, int | None, list[int]]]] = []
    for part, n_chats, i, conv, m in ends:
        joins = shared and i == 0 and shared[-1][-1][2] == conv and shared[-1][-1][0] != part
        piece = (part, n_chats if i == 0 else -1, conv, m)
        if joins:
            shared[-1].append(piece)
        else:
            shared.append([piece])
    first_of: dict[int, tuple] = {}
    last_of: dict[int, tuple] = {}
    for run in (r for r in shared if len(r) > 1):
        start = [NEVER, NEVER, NEVER, 0]
        before = [start]
        for *_, m in run:
            before.append([min(min(NEVER, before[-1][s] + m[4 * s + t]) for s in range(4)) for t in range(4)])
        after = [[END_COST[s] for s in range(4)]]
        for *_, m in reversed(run):
            after.insert(0, [min(min(NEVER, m[4 * s + t] + after[0][t]) for t in range(4)) for s in range(4)])
        cost = min(a + b for a, b in zip(before[-1], after[-1], strict=True))
        # One optimal state at each cut, chosen from the last cut back so that neighbours agree.
        state = min(range(4), key=lambda s: (before[-1][s] + after[-1][s], s))
        at = [state]
        for k in range(len(run) - 1, -1, -1):
            m = run[k][3]
            state = min(range(4), key=lambda s: (before[k][s] + m[4 * s + at[0]], s))
            at.insert(0, state)
        for k, (part, n_chats, _, _) in enumerate(run):
            here = (at[k], at[k + 1], k + 1 < len(run), cost)
            if n_chats != -1:
                first_of[part] = here
            if n_chats in (-1, 1):
                last_of[part] = here

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        previous, nth = None, 0

        def give(own: list[tuple], first: bool, last: bool) -> list[tuple]:
            part = own[0][1]
            cut = (first_of.get(part) if first else None) or (last_of.get(part) if last else None)
            roles = [role_of(r[2]) for r in own]
            if cut is None:
                fixed, begin, end = repair(roles)
                cost = costs_from([NEVER, NEVER, NEVER, 0], roles)[end] + END_COST[end]
                goes_on = False
            else:
                begin, end, goes_on, cost = cut
                fixed, _, _ = repair(roles, [0 if s == begin else NEVER for s in range(4)], [0 if s == end else NEVER for s in range(4)])
            done = render(fixed, [r[4] for r in own], begin, not goes_on)
            return [(r[0], r[3], r[5], r[2], role, "relabel" if action == "keep" and role != (r[2] or "").strip().lower() else action, text, cost) for r, (role, action, text) in zip(own, done, strict=True)]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "turn", "place", "old_role", "role", "action", "rendered", "cost"])

        for _, own in chats(batches):
            if previous is not None:
                held += give(previous, nth == 1, False)
                if len(held) >= 2000:
                    yield batch(held)
                    held = []
            previous, nth = own, nth + 1
        if previous is not None:
            held += give(previous, nth == 1, True)
            yield batch(held)

    return parts.select("conv_id", "part", "role", "turn", "text", "place").mapInArrow(formatted, "conv_id long, turn long, place long, old_role string, role string, action string, rendered string, cost long")
