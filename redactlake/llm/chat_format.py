"""Repairing the roles of conversations at least cost, and rendering them.

A legal conversation is an optional system turn, then user and assistant turns in turn, the last one by the assistant. Each
given turn keeps its role or is relabelled, and opens a new turn or is merged into the one before; empty turns may be inserted.
A dynamic program over the automaton of legal turns finds the cheapest repair. Its step for a turn is a small matrix of
costs, so that the steps of a stretch of turns combine into one: conversations that sort into several partitions are solved from
the matrices of their stretches (two a partition at most), and a conversation of any length needs no task of its own.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.store import Scratch
from redactlake.llm.texts import slices

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the turn that is open. What may follow each of them.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE_COST, INSERT_COST, RELABEL_COST = 1, 2, 3
NEVER = 1 << 40


def _between(a: int, b: int) -> tuple[int, ...] | None:
    """The fewest empty turns that lead from state `a` to a turn of role `b`."""
    ways = [(), *((x,) for x in FOLLOWS[a]), *((x, y) for x in FOLLOWS[a] for y in FOLLOWS[x])]
    return next((way for way in ways if b in FOLLOWS[(a, *way)[-1]]), None)


END_INSERTS = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _steps() -> dict[int, dict[tuple[int, int], tuple[int, tuple[int, ...], bool]]]:
    """Per given role (0 stands for any other one), from and to a state: least cost, empty turns inserted, merged or not."""
    table: dict = {given: {} for given in range(4)}
    for given, state, role in itertools.product(range(4), FOLLOWS, (SYSTEM, USER, ASSISTANT)):
        label = RELABEL_COST * (role != given)
        choices = [(label + MERGE_COST, (), True)] if state == role else []
        if (inserted := _between(state, role)) is not None:
            choices.append((label + INSERT_COST * len(inserted), inserted, False))
        if choices:
            table[given][state, role] = min(choices)
    return table


STEPS = _steps()


def solve(given: list[int], entry: int) -> tuple[list[int], list[dict[int, int]]]:
    """Least cost of reaching each state after these turns, from `entry`; per turn, the state before each state."""
    costs, back = [NEVER] * 4, []
    costs[entry] = 0
    for role in given:
        now, before = [NEVER] * 4, {}
        for (a, b), (cost, _, _) in STEPS[role].items():
            if costs[a] + cost < now[b]:
                now[b], before[b] = costs[a] + cost, a
        costs = now
        back.append(before)
    return costs, back


def path(back: list[dict[int, int]], leave: int) -> list[int]:
    """The states after each turn that lead to `leave`."""
    states = [leave]
    for before in reversed(back[1:]):
        states.append(before[states[-1]])
    return states[::-1]


def end_cost(state: int) -> int:
    return INSERT_COST * len(END_INSERTS[state]) if state else NEVER


def best_end(costs: list[int]) -> int:
    return min((SYSTEM, USER, ASSISTANT), key=lambda s: (costs[s] + end_cost(s), -s))


PLACED = (
    "conv_id bigint, turn bigint, given int, text string, part int, edge string, "
    "before int, after int, last boolean, ways array<int>, costs array<bigint>"
)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one sorted partition. Where one may go on in another partition, the states of all its ways from each
    entry to each exit are given, 16 numbers a turn, and on its first turn the matrix of costs."""
    part = TaskContext.get().partitionId()
    held: list[tuple] = []
    state = {"any": False}

    def solved(last_run: bool) -> Iterator[pa.RecordBatch]:
        edge = ("f" if not state["any"] else "") + ("l" if last_run else "")
        state["any"] = True
        given = [row[2] for row in held]
        rows = []
        if not edge:
            costs, back = solve(given, START)
            after = path(back, best_end(costs))
            for i, row in enumerate(held):
                rows.append((*row, part, "", after[i - 1] if i else START, after[i], i == len(held) - 1, None, None))
        else:
            ways, matrix = [[-1] * 16 for _ in held], []
            for entry in range(4):
                costs, back = solve(given, entry)
                matrix += costs
                for leave in range(1, 4):
                    if costs[leave] < NEVER:
                        for i, after in enumerate(path(back, leave)):
                            ways[i][4 * entry + leave] = after
            for i, row in enumerate(held):
                rows.append((*row, part, edge, -1, i, i == len(held) - 1, ways[i] + (ways[i - 1] if i else []), matrix if i == 0 else None))
        names = [column.split()[0] for column in PLACED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
        kinds += [pa.list_(pa.int32()), pa.list_(pa.int64())]
        for begin in range(0, len(rows), 10_000):
            columns = list(zip(*rows[begin : begin + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        held.clear()

    for batch in batches:
        for piece in slices(batch, "text"):
            for row in zip(*[piece.column(c).to_pylist() for c in ("conv_id", "turn", "given", "text")], strict=True):
                if held and row[0] != held[-1][0]:
                    yield from solved(False)
                held.append(row)
    if held:
        yield from solved(True)


def _joined(edges: list) -> list[tuple]:
    """For each stretch of a conversation in several parts, or at the edge of one: part, edge, entry, exit, whether it is the
    conversation's last."""
    stretches = defaultdict(list)
    for row in edges:
        stretches[row.conv_id].append(row)
    out = []
    for own in stretches.values():
        own.sort(key=lambda row: (row.part, row.edge == "l"))
        costs, back = [0, NEVER, NEVER, NEVER], []
        for row in own:
            now = [min((costs[a] + row.costs[4 * a + b], a) for a in range(4)) for b in range(4)]
            costs = [min(cost, NEVER) for cost, _ in now]
            back.append([a for _, a in now])
        leave = best_end(costs)
        for i in range(len(own) - 1, -1, -1):
            entry = back[i][leave]
            out.append((own[i].part, own[i].edge, entry, leave, i == len(own) - 1))
            leave = entry
    return out


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """One row per row of `conversations` (conv_id, turn, role, text): conv_id, turn, role (after the repair), action (keep, merge,
    relabel, relabel_merge), n_inserted (empty turns put in before it, and after it at the end), cost, rendered.

    The renderings of a conversation's rows, joined in order of turns, are the rendered conversation: a header and the text of
    each turn, merged texts on lines of their own, "<|" in texts taken apart so that they can't hold a header. Turns sort by number, nulls first,
    equal ones by role and text. Roles are compared in lower case without blanks around them; null and any other role count as
    unknown and are relabelled. Null texts are empty. Rows without conv_id are one conversation. Other columns are ignored;
    an empty table gives no rows. The driver sees two rows per partition at most.
    """
    spark = conversations.sparkSession
    role = F.trim(F.lower(F.col("role").cast("string")))
    given = F.coalesce(*[F.when(role == name, F.lit(i + 1)) for i, name in enumerate(ROLES)], F.lit(0))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        given.cast("int").alias("given"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.xxhash64("text").alias("tie"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "given", "tie"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("tie").mapInArrow(_stretches, PLACED)
    kept = Scratch(spark, "chat").keep(placed, "placed")
    edges = kept.where("costs is not null").select("conv_id", "part", "edge", "costs").collect()
    schema = "part int, edge string, entry int, leave int, final boolean"
    chosen = F.broadcast(spark.createDataFrame(_joined(edges), schema))
    own = kept.join(chosen, ["part", "edge"], "left")
    at_edge = F.col("edge") != ""
    way = 4 * F.col("entry") + F.col("leave")
    first = at_edge & (F.col("after") == 0)  # `after` numbers the turns of a stretch at an edge
    before = F.when(first, F.col("entry")).when(at_edge, F.expr("ways[16 + 4 * entry + leave]")).otherwise(F.col("before"))
    after = F.when(at_edge, F.col("ways")[way]).otherwise(F.col("after"))
    final = F.when(at_edge, F.col("last") & F.col("final")).otherwise(F.col("last"))
    stated = own.select("conv_id", "turn", "given", "text", before.alias("b"), after.alias("a"), final.alias("final"))
    steps = [(g, a, b, c, list(i), m) for g, own in STEPS.items() for (a, b), (c, i, m) in own.items()]
    table = spark.createDataFrame(steps, "given int, b int, a int, cost int, inserted array<int>, merged boolean")
    stepped = stated.join(F.broadcast(table), ["given", "b", "a"])

    names = F.array(*[F.lit(name) for name in ROLES])
    header = lambda state: F.concat(F.lit("<|"), names[state - 1], F.lit("|>\n"))
    end = F.lit("<|end|>\n")
    empty = lambda states: F.array_join(F.transform(states, lambda s: F.concat(header(s), F.lit("\n"), end)), "")
    text = F.replace("text", F.lit("<|"), F.lit("< |"))
    opened = F.concat(F.when(F.col("b") == START, "").otherwise(end), empty(F.col("inserted")), header(F.col("a")), text, F.lit("\n"))
    ends = F.when(F.col("final"), F.when(F.col("a") == SYSTEM, F.array(F.lit(USER), F.lit(ASSISTANT))).when(F.col("a") == USER, F.array(F.lit(ASSISTANT))))
    ends = F.coalesce(ends, F.array().cast("array<int>"))
    closing = F.when(F.col("final"), F.concat(end, empty(ends))).otherwise("")
    body = F.when(F.col("merged"), F.concat(text, F.lit("\n"))).otherwise(opened)
    relabelled = F.col("given") != F.col("a")
    action = (
        F.when(relabelled & F.col("merged"), "relabel_merge").when(relabelled, "relabel").when(F.col("merged"), "merge").otherwise("keep")
    )
    return stepped.select(
        "conv_id",
        "turn",
        names[F.col("a") - 1].alias("role"),
        action.alias("action"),
        (F.size("inserted") + F.size(ends)).cast("bigint").alias("n_inserted"),
        (F.col("cost") + INSERT_COST * F.size(ends)).cast("bigint").alias("cost"),
        F.concat(body, closing).alias("rendered"),
    )
