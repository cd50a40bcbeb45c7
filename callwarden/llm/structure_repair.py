"""Repair of the structure of damaged conversations at the least cost.

A conversation's rows in order of turn are edited until their role initials read ``(s?(ua)+)?``. Keep costs 0,
Rerole to user or assistant 3, Delete 4 (the only edit of blank and repeated rows), Insert of an
empty user or assistant turn 3; a truncated row that stays adds 3.

* Lattice: a node is (rows consumed, state of the role automaton: empty, s, u, a). From every state one role of u
  and a may follow, so an edit string settles the repaired rows.
* Search: Dijkstra from the first node and, over reversed edges, from the legal last nodes, each with a heap of its
  own; the smaller top is settled. Once the tops add up to more than the best meeting, every cheapest path has an
  edge from a node settled forwards to one settled backwards, or is settled forwards to its end. All of these crossings are kept.
* Audit: of all concatenations over the crossings the ASCII-least one is read off by walking the tight edges
  with the set of nodes that share the least string so far, so no strings are stored at nodes.

On Spark: damage is a column expression; equal rows of a turn are merged with a count before they are exchanged, and
the first of equal turns is found by an aggregation and a join on keys that are unique on both sides. Rows are ranged and
sorted by (conversation, turn, role, text), so a long conversation is cut into pieces, and every piece
sends one byte a row to its conversation's search. The audit is itself one character a row, and SHA-256 of the repaired
conversation has to see its rows in order: they are streamed past the audit, sorted, a batch at a time.

Defined cases: NULL role and text count as one space, and so do NULL ids and turns in the name that settles the damage.
A NULL conversation id is a conversation of its own. Rows of one turn are ordered by role, then text; equal rows
after the first are duplicates. A conversation without rows after damage has zeros, an empty audit and the hash of nothing.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.llm.common import map_arrow, stage
from callwarden.llm.merkle_manifest import sql_crc32

# --- fixed values: costs and faults
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
EMPTY, S, U, A = range(4)
#: State after the one role of user and assistant that may follow.
NEXT = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}
BLANK_TEXT = r"^[\x20\x09-\x0D]*$"
ENDED_TEXT = r"(?s)[.!?][\x20\x09-\x0D]*\z"
#: Classes of role initials; a code byte is the class plus 4 if truncated, plus 8 if the row must go.
CLASSES = "sua"
MUST_GO, CUT = 8, 4
#: Conversations of up to so many rows are remembered by their codes.
REMEMBERED_ROWS = 64


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage; dropped rows are gone."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    return out.where("kind != 0").select("conv_id", "turn", "role", "text", F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def with_codes(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn merged; ``code`` of the first copy and ``again`` of the others."""
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("said")
    merged = stage(merged.select("*", said), "repair-merged")
    firsts = merged.groupBy(F.col("conv_id").alias("fc"), F.col("said").alias("fs")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))["turn"].alias("ft"))
    same = F.col("conv_id").eqNullSafe(F.col("fc")) & F.col("turn").eqNullSafe(F.col("ft")) & (F.col("said") == F.col("fs"))
    joined = merged.join(firsts, same, "left")
    blank, repeated = F.col("text").rlike(BLANK_TEXT), F.col("fs").isNull()
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(blank, "blank").when(repeated, "duplicate").when(~F.col("text").rlike(ENDED_TEXT), "truncated")
    code = kind + F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", CUT).otherwise(0)
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"), code.cast("int").alias("code"))


# ---------------------------------------------------------------- search


def _leaving(codes: bytes, i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, rows consumed, state, cost) of the edits at a node."""
    nxt = NEXT[q]
    if i < len(codes):
        code = codes[i]
        if code < MUST_GO:
            more, kind = (TRUNCATED, code - CUT) if code >= CUT else (0, code)
            if kind == 0 and q == EMPTY:
                yield "K", i + 1, S, more
            elif kind and kind != 3 and kind + 1 == nxt:
                yield "K", i + 1, nxt, more
            yield "R", i + 1, nxt, REROLE + more
        yield "D", i + 1, q, DELETE
    yield "I", i, nxt, INSERT


_BEFORE = {EMPTY: (), S: (), U: (EMPTY, S, A), A: (U,)}


def _entering(codes: bytes, i: int, q: int) -> Iterator[tuple[int, int, int]]:
    """(rows consumed, state, cost) of the nodes with an edit that leads to a node."""
    for p in _BEFORE[q]:
        yield i, p, INSERT
    if i:
        code = codes[i - 1]
        yield i - 1, q, DELETE
        if code < MUST_GO:
            more, kind = (TRUNCATED, code - CUT) if code >= CUT else (0, code)
            if kind == 0 and q == S:
                yield i - 1, EMPTY, more
            for p in _BEFORE[q]:
                yield i - 1, p, more if kind and kind + 1 == q else REROLE + more


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """(cost, audit): the least cost, and of the cheapest edit strings the ASCII-least."""
    nodes = 4 * (len(codes) + 1)
    far = 1 << 60
    reached = [array("q", [far]) * nodes, array("q", [far]) * nodes]
    settled = [bytearray(nodes), bytearray(nodes)]
    heaps: list[list[int]] = [[], []]
    ends = [4 * len(codes) + EMPTY, 4 * len(codes) + A]
    for side, starts in ((0, [EMPTY]), (1, ends)):
        for node in starts:
            reached[side][node] = 0
            heappush(heaps[side], node)
    best = far

    def top(side: int) -> int:
        heap = heaps[side]
        while heap and (settled[side][heap[0] % nodes] or heap[0] // nodes > reached[side][heap[0] % nodes]):
            heappop(heap)
        return heap[0] // nodes if heap else far

    while True:
        tops = top(0), top(1)
        if tops[0] + tops[1] > best:
            break
        side = 0 if tops[0] <= tops[1] else 1
        cost, node = divmod(heappop(heaps[side]), nodes)
        settled[side][node] = 1
        i, q = divmod(node, 4)
        edges = [(j, p, c) for _, j, p, c in _leaving(codes, i, q)] if side == 0 else _entering(codes, i, q)
        best = min(best, cost + reached[1 - side][node])
        for j, p, c in edges:
            other, new = 4 * j + p, cost + c
            if new < reached[side][other]:
                reached[side][other] = new
                heappush(heaps[side], new * nodes + other)
                best = min(best, new + reached[1 - side][other])
    # what is left to pay at each node of a cheapest path: known backwards, or marked back from the crossings
    left = array("q", [-1]) * nodes
    for node in range(nodes):
        if settled[1][node]:
            left[node] = reached[1][node]
    marked = [end for end in ends if left[end] < 0 and settled[0][end] and reached[0][end] == best]
    for node in marked:
        left[node] = 0
    for node in range(nodes):
        if settled[0][node] and left[node] < 0:
            i, q = divmod(node, 4)
            for _, j, p, c in _leaving(codes, i, q):
                other = 4 * j + p
                if settled[1][other] and reached[0][node] + c + reached[1][other] == best:
                    left[node] = best - reached[0][node]
                    marked.append(node)
                    break
    while marked:
        node = marked.pop()
        for j, p, c in _entering(codes, *divmod(node, 4)):
            other = 4 * j + p
            if settled[0][other] and left[other] < 0 and reached[0][other] + c == reached[0][node]:
                left[other] = best - reached[0][other]
                marked.append(other)
    front, audit = {EMPTY}, []
    goal = set(ends)
    while not any(node in goal and left[node] == 0 for node in front):
        least, following = "~", set()
        for node in front:
            for initial, j, p, c in _leaving(codes, *divmod(node, 4)):
                other = 4 * j + p
                if initial <= least and left[other] >= 0 and left[other] == left[node] - c:
                    if initial < least:
                        least, following = initial, set()
                    following.add(other)
        audit.append(least)
        front = following
    return best, "".join(audit)


_remembered = lru_cache(maxsize=1 << 16)(cheapest_edits)


def illegal_neighbours(codes: bytes) -> int:
    """Adjacent rows whose role initials aren't su, ua or au."""
    kinds = [code & 3 for code in codes]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(kinds, kinds[1:]))


# ---------------------------------------------------------------- Arrow stages


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of a conversation within a batch its code bytes and its turns.

    A task may read several files in any order, so a run ends where the rows' numbers have a gap.
    """
    for batch in batches:
        convs, turns, copies, codes, at = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "copies", "code", "at"))
        out: list[list] = [[] for _ in range(6)]
        row = 0
        while row < len(convs):
            end = row
            text = bytearray()
            known = 0
            while end < len(convs) and convs[end] == convs[row] and at[end] == at[row] + end - row:
                text.append(codes[end])
                text.extend(bytes([codes[end] & 3 | MUST_GO]) * (copies[end] - 1))
                known += turns[end] is not None and (end == row or turns[end] != turns[end - 1])
                end += 1
            for column, value in zip(out, (convs[row], at[row], bytes(text), next((t for t in turns[row:end] if t is not None), None), turns[end - 1], known), strict=True):
                column.append(value)
            row = end
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["conv_id", "at", "codes", "first", "last", "turns"])


OUT = "conv_id long, gaps long, illegal long, cost long, audit string, repaired_sha256 string, inserted long, deleted long, reroled long"
_NAMES = [c.split()[0] for c in OUT.split(", ")]


class _Conversation:
    """Pieces first, then rows: searches once, then feeds the repaired rows to the hash."""

    def __init__(self) -> None:
        self.codes: list[bytes] = []
        self.low = self.high = None
        self.turns = 0
        self.audit: str | None = None
        self.cost = self.illegal = 0

    def piece(self, codes: bytes, first: int | None, last: int | None, turns: int) -> None:
        self.codes.append(codes)
        if turns:
            self.turns += turns - (self.high == first)
            self.low = first if self.low is None else self.low
            self.high = last

    def search(self) -> None:
        codes = b"".join(self.codes)
        self.cost, self.audit = (_remembered if len(codes) <= REMEMBERED_ROWS else cheapest_edits)(codes)
        self.illegal = illegal_neighbours(codes)
        self.codes, self.at, self.state, self.hash, self.size = [], 0, EMPTY, hashlib.sha256(), 0

    def write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.size else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.size += 1

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self.write(ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = S if role[:1] == "s" else NEXT[self.state]
                self.write(role, text)
            elif edit == "R":
                self.state = NEXT[self.state]
                self.write(ROLE[self.state], text)

    def result(self, conv: int | None) -> tuple:
        if self.audit is None:
            self.search()
        self.inserts()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return conv, gaps, self.illegal, self.cost, self.audit, self.hash.hexdigest(), *(self.audit.count(c) for c in "IDR")


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, kind, at): 0 marks a conversation, 1 are its pieces, 2 its rows."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3]
    now, conv = None, None

    def flush(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=_NAMES)

    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "codes", "first", "last", "turns", "role", "text", "copies")]
        for conv_id, kind, codes, first, last, turns, role, text, copies in zip(*columns, strict=True):
            if kind == 0:
                if now is not None:
                    done.append(now.result(conv))
                now, conv = _Conversation(), conv_id
            elif kind == 1:
                now.piece(codes, first, last, turns)
            else:
                if now.audit is None:
                    now.search()
                now.row(role, text, copies)
        if done:
            yield flush(done)
    if now is not None:
        yield flush([now.result(conv)])


# ---------------------------------------------------------------- Spark side


def repair_conversations(conversations: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of ``conversations``: faults, cost, audit and the hash of its repair.

    ``damaged`` has the rows to repair (conv_id, turn, role, text, copies); by default the
    conversations after :func:`damage`.
    """
    rows = with_codes(damage(conversations) if damaged is None else damaged)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = stage(ranged, "repair-rows")
    pieces = map_arrow(ranged.select("conv_id", "turn", "copies", "code", "at"), _pieces, "conv_id long, at long, codes binary, first long, last long, turns long")
    convs = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    marks = convs.select("conv_id", F.lit(0).alias("kind"))
    pieces = pieces.withColumn("kind", F.lit(1))
    texts = ranged.select("conv_id", F.lit(2).alias("kind"), "at", "role", "text", "copies")
    feed = marks.unionByName(pieces, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    feed = feed.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "at")
    repaired = map_arrow(feed, _repair, OUT)
    again = F.col("copies") - 1
    is_blank = F.col("fault") == "blank"
    counts = ranged.groupBy(F.col("conv_id").alias("cc")).agg(
        F.sum(F.when(is_blank, F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(is_blank, 0).when(F.col("fault") == "duplicate", F.col("copies")).otherwise(again)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0)).alias("truncated"),
    )
    joined = repaired.join(counts, repaired.conv_id.eqNullSafe(counts.cc), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("conv_id", "gaps", zero("blank"), zero("duplicate"), zero("truncated"), "illegal", "cost", "audit", "repaired_sha256", "inserted", "deleted", "reroled")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The cheapest suffix of edits from every node, row by row from the last one backwards.
SQL = f"""
WITH RECURSIVE named AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {sql_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS f
  FROM conversations
), damaged AS (
  SELECT k, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM named, range(2) copy(c) WHERE f <> 0 AND (c = 0 OR f = 3)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY k) AS n,
    substr(role, 1, 1) AS c,
    lag(substr(role, 1, 1)) OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS p
  FROM damaged
), rows_ AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM (SELECT *, i > min(i) OVER (PARTITION BY k, role, text) AS seen FROM ordered)
), pre(q, cost, audit, said, q1) AS (
  SELECT q, 0, '', CAST([] AS VARCHAR[]), q FROM (VALUES ('e'), ('s'), ('u'), ('a')) v(q) UNION ALL
  VALUES ('e', 3, 'I', ['user:'], 'u'), ('s', 3, 'I', ['user:'], 'u'), ('a', 3, 'I', ['user:'], 'u'), ('u', 3, 'I', ['assistant:'], 'a'),
    ('e', 6, 'II', ['user:', 'assistant:'], 'a'), ('s', 6, 'II', ['user:', 'assistant:'], 'a'), ('a', 6, 'II', ['user:', 'assistant:'], 'a'), ('u', 6, 'II', ['assistant:', 'user:'], 'u')
), steps AS (
  SELECT k, i, q1, edit, q2, item, CASE edit WHEN 'K' THEN 0 WHEN 'R' THEN 3 ELSE 4 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost FROM (
    SELECT k, i, fault, q AS q1, 'D' AS edit, q AS q2, CAST([] AS VARCHAR[]) AS item FROM rows_, (VALUES ('e'), ('s'), ('u'), ('a')) v(q)
    UNION ALL SELECT k, i, fault, q, 'R', r, [CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM rows_, (VALUES ('e', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')) v(q, r)
      WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT k, i, fault, q, 'K', r, [role || ':' || text] FROM rows_, (VALUES ('e', 's'), ('e', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')) v(q, r)
      WHERE fault NOT IN ('blank', 'duplicate') AND c = r)
), best(k, i, q, found) AS (
  SELECT k, n, q, {{'cost': cost, 'audit': audit, 'said': said}} FROM (SELECT DISTINCT k, n FROM rows_), (
    SELECT q, cost, audit, said FROM pre WHERE q1 IN ('e', 'a') AND (q = q1 OR cost = 3 OR q = 's') AND NOT (q = 'e' AND q1 = 'a'))
  UNION ALL
  SELECT s.k, s.i - 1, pre.q, min({{'cost': pre.cost + s.cost + b.found.cost, 'audit': pre.audit || s.edit || b.found.audit, 'said': pre.said || s.item || b.found.said}})
  FROM best b JOIN steps s ON b.k = s.k AND b.i = s.i AND b.q = s.q2 JOIN pre ON pre.q1 = s.q1 GROUP BY ALL
), sums AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND p || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY k
), answers AS (SELECT k, found.cost AS cost, found.audit AS audit, array_to_string(found.said, chr(10)) AS said FROM best WHERE i = 0 AND q = 'e')
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256, CAST(length(coalesce(audit, '')) - length(replace(coalesce(audit, ''), 'I', '')) AS BIGINT) AS inserted,
  CAST(length(coalesce(audit, '')) - length(replace(coalesce(audit, ''), 'D', '')) AS BIGINT) AS deleted, CAST(length(coalesce(audit, '')) - length(replace(coalesce(audit, ''), 'R', '')) AS BIGINT) AS reroled
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS k FROM conversations) LEFT JOIN sums USING (k) LEFT JOIN answers USING (k)"""

QUERIES = {"op11_structure_repair": (op11_structure_repair, SQL)}
