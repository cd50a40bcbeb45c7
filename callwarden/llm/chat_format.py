"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation,
beginning with the user. Turns that break this are repaired at least total cost by dynamic
programming over the states of that automaton. For each turn one may

* keep it (0), after an empty turn put before it (``INSERT``) if needed;
* merge it into the turn before, of the same role (``MERGE``) or of another (``FOREIGN``);
* give it a role that is legal there (``RELABEL``; ``UNKNOWN`` for a role that isn't known).

Equal costs are settled in the order keep, merge, insert, relabel, then by the automaton's order.

Conversations of any length are split: turns are range-partitioned by conversation and place, and
each part of a conversation is one (min, +) matrix over the states. Only for conversations that
lie in several parts (at most two for each part) these matrices are joined, which settles where
each part begins and ends; then all parts are repaired on their own. Nothing holds a whole
conversation, and each turn is returned as the segment that it adds to the rendering: the segments
of a conversation in order are its text.

Defined cases: NULL turns come first; equal turns are ordered by role, then text; repeated rows
each count. Roles are trimmed and lower-cased, and ``ALIASES`` name the usual other spellings;
any other role, or NULL, is unknown. NULL text is empty. Rows without a conversation id are left
out. Markers inside texts are broken up, so a text can't forge a turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.llm.common import map_arrow, stage

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "model": "assistant", "gpt": "assistant", "ai": "assistant", "developer": "system"}
KEEP, MERGE, INSERT, UNKNOWN, RELABEL, FOREIGN = 0, 1, 2, 1, 3, 5
#: States: nothing yet, then the role of the last turn. Next roles that are legal from each.
START = 0
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
STATES = 4
FAR = 1 << 40
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"

Move = tuple[int, int, int, str, int]  # cost, state before, state after, action, inserted role or 0


def _moves(role: int) -> list[Move]:
    """Moves for a turn of a role (1 to 3, or 0 if unknown), in order of preference."""
    found: list[Move] = []
    for state, legal in NEXT.items():
        if role in legal:
            found.append((KEEP, state, role, "keep", 0))
        if state == role != START:
            found.append((MERGE, state, state, "merge", 0))
        elif state != START:
            found.append((FOREIGN, state, state, "merge", 0))
        found += [(INSERT, state, role, "keep", between) for between in legal if role in NEXT[between]]
        found += [(UNKNOWN if role == 0 else RELABEL, state, other, "relabel", 0) for other in legal if other != role]
    rank = {"keep": 0, "merge": 1, "relabel": 3}
    return sorted(found, key=lambda m: (2 if m[4] else rank[m[3]], m[1], m[2]))


MOVES = [_moves(role) for role in range(4)]


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def costs(roles: list[int], enter: int | None = None) -> np.ndarray:
    """Least costs from every state (or ``enter``) over these turns to every state."""
    table = np.full((STATES, STATES), FAR)
    for state in range(STATES) if enter is None else (enter,):
        row = [FAR] * STATES
        row[state] = 0
        for role in roles:
            new = [FAR] * STATES
            for cost, a, b, _, _ in MOVES[role]:
                if row[a] + cost < new[b]:
                    new[b] = row[a] + cost
            row = new
        table[state] = row
    return table


def repair(roles: list[int], enter: int = START, leave: int | None = None) -> list[Move]:
    """Cheapest moves, one for each turn, from a state to a state (or to the cheapest)."""
    row, back = [FAR] * STATES, []
    row[enter] = 0
    for role in roles:
        new, step = [FAR] * STATES, [None] * STATES
        for move in MOVES[role]:
            cost = row[move[1]] + move[0]
            if cost < new[move[2]]:
                new[move[2]], step[move[2]] = cost, move
        row = new
        back.append(step)
    state = min(range(STATES), key=row.__getitem__) if leave is None else leave
    out = []
    for step in reversed(back):
        out.append(step[state])
        state = step[state][1]
    return out[::-1]


def _safe(text: str | None) -> str:
    return (text or "").replace("<|", "< |")


def segments(moves: list[Move], texts: list[str | None], opening: bool, closing: bool) -> list[str]:
    """What each turn adds to the rendering."""
    out = []
    for number, (move, text) in enumerate(zip(moves, texts, strict=True)):
        _, _, state, action, between = move
        if action == "merge":
            part = "\n" + _safe(text)
        else:
            part = "" if opening and number == 0 else "\n" + CLOSE
            if between:
                part += OPEN.format(ROLES[between - 1]) + "\n" + CLOSE
            part += OPEN.format(ROLES[state - 1]) + _safe(text)
        out.append(part + ("\n" + CLOSE if closing and number == len(moves) - 1 else ""))
    return out


# ---------------------------------------------------------------- Spark


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple[int, int], dict[str, list]]]:
    """Consecutive rows of one (conv_id, part)."""
    name, held = None, {c: [] for c in columns}
    for batch in batches:
        keys = list(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), strict=True))
        values = {c: batch.column(c).to_pylist() for c in columns}
        for i, key in enumerate(keys):
            if key != name:
                if name is not None:
                    yield name, held
                name, held = key, {c: [] for c in columns}
            for c in columns:
                held[c].append(values[c][i])
    if name is not None:
        yield name, held


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv, part), rows in _runs(batches, ["role"]):
        table = costs([role_number(r) for r in rows["role"]])
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([table.ravel()], pa.list_(pa.int64()))], names=["conv_id", "part", "costs"])


def _ways(parts: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(part, state at its begin, state at its end) of a conversation's parts in order."""
    row, back = np.full(STATES, FAR), []
    row[START] = 0
    for _, table in parts:
        total = row[:, None] + table
        back.append(total.argmin(axis=0))
        row = total.min(axis=0)
    state = int(row.argmin())
    out = []
    for (part, _), step in zip(reversed(parts), reversed(back), strict=True):
        before = int(step[state])
        out.append((part, before, state))
        state = before
    return out[::-1]


OUT = "conv_id long, turn long, place long, role string, role_out string, action string, inserted string, cost int, segment string"


def _repairer(ways: dict):
    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        size = 0
        for (conv, part), rows in _runs(batches, ["turn", "place", "role", "text"]):
            enter, leave, opening, closing = ways.value.get((conv, part), (START, None, True, True))
            moves = repair([role_number(r) for r in rows["role"]], enter, leave)
            texts = segments(moves, rows["text"], opening, closing)
            new = [
                [conv] * len(moves), rows["turn"], rows["place"], rows["role"], [ROLES[m[2] - 1] for m in moves], [m[3] for m in moves],
                [ROLES[m[4] - 1] if m[4] else None for m in moves], [m[0] for m in moves], texts,
            ]
            for column, values in zip(out, new, strict=True):
                column += values
            size += sum(map(len, texts))
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                out, size = [[] for _ in names], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each turn: role given, action, empty turn put before, cost and segment.

    ``place`` orders the turns of a conversation, also equal ones.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = ["conv_id", "turn", "role", "tie"]
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    placed = ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).drop("tie")
    placed = stage(placed, "chat-turns")

    def runs(columns: list[str]) -> DataFrame:
        return placed.select("conv_id", "part", *columns).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place")

    split = placed.select("conv_id", "part").distinct().groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    narrow = placed.select("conv_id", "part", "place", "role").join(split, "conv_id", "left_semi")
    tables = map_arrow(narrow.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place"), _matrices, "conv_id long, part int, costs array<long>")
    # a part cuts two conversations at most, so these are at most twice as many rows as parts
    by_conv: dict[int, list] = {}
    for conv, part, table in tables.orderBy("conv_id", "part").collect():
        by_conv.setdefault(conv, []).append((part, np.array(table).reshape(STATES, STATES)))
    ways = {}
    for conv, pieces in by_conv.items():
        for number, (part, enter, leave) in enumerate(_ways(pieces)):
            ways[conv, part] = (enter, leave, number == 0, number == len(pieces) - 1)
    return map_arrow(runs(["turn", "place", "role", "text"]), _repairer(spark.sparkContext.broadcast(ways)), OUT)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op3_chat_format": (op3_chat_format, None)}
