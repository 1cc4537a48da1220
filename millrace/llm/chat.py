"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant. Each
given turn is kept, relabelled or merged into the turn before it, and an empty turn may be inserted before it;
dynamic programming over the automaton's states finds the cheapest repair (ties: keep, merge, relabel, insert).

The turns are put in order over the whole table (a range partitioning) and numbered within each conversation; every
``BLOCK_TURNS`` of them are a block, however many rows share a turn number. A block is a (state in, state out) table
of least costs, such tables are chained per conversation, and each block is then repaired between its two states: no
task needs a whole conversation, and the rendering is a row per turn whose fragments, in order, are the rendered text.
Control strings in a turn's own text are escaped, so no text can forge a turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import lean, read_table, written

ROLES = ("system", "user", "assistant")
#: Spellings that are the same role.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
#: States: before the first turn, and after a turn of each role. NEXT has the roles that may follow.
START, STATES = 0, 4
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 2, 1, 3
BLOCK_TURNS = 1024
INFINITE = 1 << 40
#: Least cost of the insertions that end a conversation legally, from each state, and the roles inserted.
ENDING = {0: (2 * INSERT, (2, 3)), 1: (2 * INSERT, (2, 3)), 2: (INSERT, (3,)), 3: (0, ())}


def role_of(role: str | None) -> int:
    """1 to 3, or 0 if it is none of the roles."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def _moves() -> dict[int, list[tuple[int, int, int, str, int]]]:
    """Per given role: (from, to, cost, action, inserted role or 0), best first where costs tie."""
    out = {}
    for given in range(4):
        change = lambda to: 0 if to == given else RELABEL if given else RELABEL_UNKNOWN  # noqa: B023, E731
        rows = []
        for s in range(STATES):
            for to in NEXT[s]:
                rows.append((s, to, change(to), "keep" if to == given else "relabel", 0))
            if s:
                rows.append((s, s, MERGE + change(s), "merge", 0))
            for between in NEXT[s]:
                for to in NEXT[between]:
                    rows.append((s, to, INSERT + change(to), "keep" if to == given else "relabel", between))
        rank = {"keep": 0, "merge": 1, "relabel": 2}
        out[given] = sorted(rows, key=lambda m: (m[2], m[4] > 0, rank[m[3]], m[1]))
    return out


MOVES = _moves()


def block_costs(roles: list[int]) -> list[list[int]]:
    """Least cost from each state to each state over these turns."""
    table = []
    for entry in range(STATES):
        cost = [INFINITE] * STATES
        cost[entry] = 0
        for r in roles:
            after = [INFINITE] * STATES
            for s, to, c, _, _ in MOVES[r]:
                if cost[s] + c < after[to]:
                    after[to] = cost[s] + c
            cost = after
        table.append(cost)
    return table


def repair(roles: list[int], entry: int, leave: int) -> list[tuple[int, str, int]]:
    """(role, action, inserted role before it or 0) of each turn, at least cost between the two states."""
    cost = [INFINITE] * STATES
    cost[entry] = 0
    steps = []
    for r in roles:
        after, how = [INFINITE] * STATES, [None] * STATES
        for move in MOVES[r]:
            s, to, c = move[:3]
            if cost[s] + c < after[to]:
                after[to], how[to] = cost[s] + c, move
        cost = after
        steps.append(how)
    out, state = [], leave
    for how in reversed(steps):
        s, to, _, action, between = how[state]
        out.append((to, action, between))
        state = s
    return out[::-1]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows that agree in the first ``keys`` columns."""
    now, rows = None, []
    for batch in batches:
        names = batch.schema.names[:keys]
        for row in batch.to_pylist():
            key = tuple(row[n] for n in names)
            if rows and key != now:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_NUMBERED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("part", pa.int64()), ("own", pa.int64())])
_COSTS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])
_PATHS = pa.schema([("p_conv", pa.int64()), ("p_block", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), ("cost", pa.int64())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("fragment", pa.string()), ("cost", pa.int64())])
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered turns with the number of their partition, and their own number within it and their conversation."""
    part, last, own = TaskContext.get().partitionId(), None, -1
    for batch in batches:
        n, conv = len(batch), batch.column(0)
        if not n:
            continue
        ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
        null = conv.is_null().to_numpy(zero_copy_only=False)
        new = np.concatenate([[(ids[0], null[0]) != last], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(new, at, -1))
        number = np.where(first < 0, own + 1 + at, at - first)
        last, own = (ids[-1], null[-1]), int(number[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(np.full(n, part, np.int64)), pa.array(number.astype(np.int64))], schema=_NUMBERED)


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at): the turns numbered from 0 within each conversation, in one order of the table.

    A partition holds a range of the order, so at most one conversation goes on from the partition before: its offset
    is a sum over partitions, and there are fewer such rows than partitions.
    """
    c = F.col
    turns = conversations.select(c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), c("role").cast("string").alias("role"), c("text").cast("string").alias("text"))
    order = ["conv_id", c("turn").asc_nulls_last(), c("role").asc_nulls_last(), c("text").asc_nulls_last(), "__salt"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = turns.withColumn("__salt", F.monotonically_increasing_id())  # equal rows may fall in several partitions
    ranged = salted.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    rows = written(ranged.mapInArrow(lean(_number), _ddl(_NUMBERED)), "chat-turns")
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("before", before).where("before > 0").select(c("conv_id").alias("o_conv"), c("part").alias("o_part"), "before")
    joined = rows.join(F.broadcast(offsets), c("conv_id").eqNullSafe(c("o_conv")) & (c("part") == c("o_part")), "left")
    return joined.select("conv_id", "turn", "role", "text", (c("own") + F.coalesce("before", F.lit(0))).alias("at"))


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(((*key, sum(block_costs([role_of(r["role"]) for r in rows]), [])) for key, rows in _groups(batches, 2)), _COSTS)


def chain(tables: list[np.ndarray]) -> tuple[list[tuple[int, int]], int]:
    """(entry, leave) of each block and the whole cost, with the cheapest legal ending."""
    ahead = np.array([ENDING[s][0] for s in range(STATES)])
    later = [ahead]
    for t in reversed(tables):
        later.append((t + later[-1][None, :]).min(axis=1))
    later = later[::-1]
    state, out = START, []
    for t, rest in zip(tables, later[1:]):
        leave = int((t[state] + rest).argmin())
        out.append((state, leave))
        state = leave
    return out, int(later[0][START])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (conv,), blocks in _groups(batches, 1):
            found, cost = chain([np.array(b["costs"]).reshape(STATES, STATES) for b in blocks])
            for k, (b, (entry, leave)) in enumerate(zip(blocks, found)):
                yield conv, b["block"], entry, leave, k == len(blocks) - 1, cost

    yield from _batches(rows(), _PATHS)


def head(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


TURN_END = "<|end|>\n"
CONTROL = re.compile(r"<(\\*)\|")


def escaped(text: str) -> str:
    """``text`` with a backslash put into every "<|"; one more where it has some already, so that it can be undone."""
    return CONTROL.sub(r"<\1\\|", text)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (conv, block), turns in _groups(batches, 2):
            entry, leave, last, cost = (turns[0][k] for k in ("entry", "leave", "last", "cost"))
            at, opened = 0, entry != START
            for turn, (role, action, between) in zip(turns, repair([role_of(t["role"]) for t in turns], entry, leave)):
                if between:
                    yield conv, block, at, None, ROLES[between - 1], "insert", TURN_END * opened + head(between), cost
                    at, opened = at + 1, True
                text = escaped(turn["text"] or "")
                yield conv, block, at, turn["turn"], ROLES[role - 1], action, ("\n" if action == "merge" else TURN_END * opened + head(role)) + text, cost
                at, opened = at + 1, True
            if last:
                for role in ENDING[leave][1]:
                    yield conv, block, at, None, ROLES[role - 1], "insert", TURN_END * opened + head(role), cost
                    at, opened = at + 1, True
                yield conv, block, at, None, None, "end", TURN_END, cost

    yield from _batches(rows(), _TURNS)


def format_chats(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Rows (conv_id, block, at, turn, role, action, fragment, cost), a row per turn of the repaired conversations.

    The fragments of a conversation in the order of (block, at) are its rendering. Turns go by (turn, role, text),
    nulls last; equal ones are repeated turns and are repaired like any. A null text is empty; a null or unknown
    role is relabelled at a lower cost. Rows of a null conv_id are one conversation. Blocks are of ``block_turns``
    rows, which a worker holds with their texts; a conversation's cost tables (16 numbers a block) are chained in
    one task. An empty table gives no rows; other columns are ignored.
    """
    turns = written(numbered(conversations).withColumn("block", F.floor(F.col("at") / block_turns).cast("long")), "chat-numbered")
    by_block = lambda df: df.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    costs = by_block(turns.select("conv_id", "block", "role", "at")).select("conv_id", "block", "role").mapInArrow(lean(_costs), _ddl(_COSTS))
    paths = costs.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(lean(_paths), _ddl(_PATHS))
    joined = turns.join(paths, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("block") == F.col("p_block")))
    ready = by_block(joined.select("conv_id", "block", "at", "turn", "role", "text", "entry", "leave", "last", "cost"))
    return ready.select("conv_id", "block", "turn", "role", "text", "entry", "leave", "last", "cost").mapInArrow(lean(_render), _ddl(_TURNS))


def rendered_blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, turns, merged, relabelled, inserted, cost, text): the rendering of each block, whole for
    conversations of one block. turns: as of ``format_chats``; cost is the conversation's."""
    parts = F.array_sort(F.collect_list(F.struct("at", "fragment")))
    made = lambda action, name: F.count(F.when(F.col("action") == action, 1)).alias(name)
    given = F.count(F.when(F.col("action").isin("keep", "merge", "relabel"), 1)).alias("turns")
    text = F.concat_ws("", F.transform(parts, lambda x: x["fragment"])).alias("text")
    return turns.groupBy("conv_id", "block").agg(given, made("merge", "merged"), made("relabel", "relabelled"), made("insert", "inserted"), F.max("cost").alias("cost"), text)


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, text, cost) of each conversation, for conversations that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "fragment")))
    return turns.groupBy("conv_id").agg(F.concat_ws("", F.transform(parts, lambda x: x["fragment"])).alias("text"), F.max("cost").alias("cost"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_blocks(format_chats(read_table(spark, sf_dir, "conversations")))
