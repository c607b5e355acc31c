"""Structure of conversations: the cheapest edits that give well-formed turns.

A repaired conversation has an optional system turn and then user and assistant
in turn, or nothing at all.  Four states say what may come next: nothing yet,
after system, after user, after assistant.  Each row is a step from state to
state (keep, rerole or delete it, after up to two inserted turns), so what lies
before or behind a point of a conversation is told by a vector of four costs.

Reconstruction is Hirschberg's: the cost vector of the front half, computed
forwards, and that of the back half, computed backwards, meet in the middle; of
the crossings with the least sum the one whose audit comes first is taken, and
both halves are solved alike.  No table of states by rows is ever held.  Which
audit comes first is known without writing it down: the audits of one half all
have as many letters other than I, and end with one, so none begins another,
and a rank per state, carried with the costs, orders them.

Long conversations are split: rows are put in order by a range exchange and cut
into chunks of bounded size.  A chunk is told by the cost and rank between each
two states, sixteen pairs, and is then itself a step; the same procedure over
the chunks of a conversation gives each chunk the states to be solved between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, kept, own_column

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: What rerole, delete, insert and an undeleted truncated row cost.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: The state after a turn is inserted, and after a turn with this initial is kept.
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_LEGAL = ("su", "ua", "au")
#: Inserts that end a conversation in each state.
TRAILING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
SPACES = " \t\n\x0b\x0c\r"

#: Costs and ranks of four states; None where a state cannot be reached.
Vector = tuple[tuple[int, int] | None, ...]
#: Cost and order of the step between each two states.
Step = tuple[tuple[tuple[int, object] | None, ...], ...]


def remembered(function: Callable, most: int = 1 << 16) -> Callable:
    """A function of hashable values that keeps its results; a closure, so that it travels to the workers by value."""
    known: dict = {}

    def call(*args):
        if args not in known:
            if len(known) >= most:
                known.clear()
            known[args] = function(*args)
        return known[args]

    return call


def _after(state: int, initial: str) -> int | None:
    """The state after a turn whose role begins with ``initial``; None if it may not stand there."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "ua"[_NEXT[state] == ASSISTANT]:
        return _NEXT[state]
    return None


@remembered
def row_step(initial: str, fault: int) -> Step:
    """What a row may become, by the states before and after it: the cheapest edits, of equally cheap ones those first in order."""
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]

    def offer(p: int, q: int, cost: int, edits: str) -> None:
        if table[p][q] is None or (cost, edits) < table[p][q]:
            table[p][q] = (cost, edits)

    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    for p in range(4):
        state = p
        for inserts in range(3):
            cost, edits = inserts * INSERT_COST, INSERT * inserts
            offer(p, state, cost + DELETE_COST, edits + DELETE)
            if fault not in (BLANK, DUPLICATE):
                if (q := _after(state, initial)) is not None:
                    offer(p, q, cost + extra, edits + KEEP)
                offer(p, _NEXT[state], cost + extra + REROLE_COST, edits + REROLE)
            state = _NEXT[state]
    return tuple(tuple(row) for row in table)


def _ranked(found: Sequence[tuple[int, object] | None]) -> Vector:
    """Costs from zero, and orders as ranks."""
    order = {k: i for i, k in enumerate(sorted({f[1] for f in found if f}))}
    least = min(f[0] for f in found if f)
    return tuple(f and (f[0] - least, order[f[1]]) for f in found)


def _forward(vector: Vector, step: Step) -> Vector:
    found = []
    for start in range(0, len(vector), 4):
        for q in range(4):
            ways = [(v[0] + s[0], (v[1], s[1])) for p in range(4) if (v := vector[start + p]) and (s := step[p][q])]
            found.append(min(ways, default=None))
    return _ranked(found)


def _backward(vector: Vector, step: Step) -> Vector:
    found = []
    for p in range(4):
        ways = [(v[0] + s[0], (s[1], v[1])) for q in range(4) if (v := vector[q]) and (s := step[p][q])]
        found.append(min(ways, default=None))
    return _ranked(found)


#: Steps of rows are few and vectors hold small differences, so nearly every step has been seen before.
_forward_row = remembered(_forward)
_backward_row = remembered(_backward)


def only(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in range(4))


def crossing(front: Vector, back: Vector) -> int:
    """The state in which a front and a back half meet at the least cost, and of such states with the first audit."""
    return min((f[0] + b[0], f[1], b[1], s) for s, (f, b) in enumerate(zip(front, back)) if f and b)[-1]


def crossings(steps: Sequence[Step], start: int, end: int, rows: bool) -> list[int]:
    """The states between all steps, ``start`` and ``end`` included, on the best way between these two."""
    forward, backward = (_forward_row, _backward_row) if rows else (_forward, _backward)
    states = [start] * len(steps) + [end]
    todo = [(0, len(steps))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        front, back = only(states[low]), only(states[high])
        for step in steps[low:middle]:
            front = forward(front, step)
        for i in range(high - 1, middle - 1, -1):
            back = backward(back, steps[i])
        states[middle] = crossing(front, back)
        todo += [(low, middle), (middle, high)]
    return states


def final_state(front: Vector) -> int:
    """The state in which a conversation's last row leaves it."""
    back = tuple((TRAILING[s] * INSERT_COST, TRAILING[s]) for s in range(4))
    return crossing(front, back)


# --------------------------------------------------------------------------
# chunks

_ROWS = "conv_id {id}, turn bigint, role string, text string, fault int, chunk bigint, at int"
_SUMMARY = "size int, initials string, illegal bigint, first_turn bigint, last_turn bigint, min_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, costs array<int>, ranks array<int>"


class Chunk:
    """What is known of a run of rows of one conversation."""

    #: The empty run, between each state and itself.
    START: Vector = tuple((0, 0) if p == q else None for p in range(4) for q in range(4))

    def __init__(self, conv_id: object, number: int):
        self.conv_id, self.number, self.size, self.bytes = conv_id, number, 0, 0
        self.first = self.last = ""
        self.first_turn = self.last_turn = self.min_turn = None
        self.illegal = self.turns = self.base = 0
        self.faults = [0] * 4
        self.vector = self.START

    def add(self, turn: int | None, initial: str, fault: int, length: int) -> None:
        if self.size == 0:
            self.first, self.first_turn = initial, turn
        elif self.last + initial not in _LEGAL:
            self.illegal += 1
        if turn is not None and (self.size == 0 or turn != self.last_turn):
            self.turns += 1
            self.min_turn = turn if self.min_turn is None else self.min_turn
        self.last, self.last_turn = initial, turn
        self.size, self.bytes = self.size + 1, self.bytes + length
        self.faults[fault] += 1
        step = row_step(initial if initial in ("s", "u", "a") else "", fault)
        # Vectors count from zero; what was taken off is the least cost so far, that of deleting nothing that may stay.
        before = self.vector
        self.vector = _forward_row(before, step)
        self.base += _least_of(before, step)

    def row(self) -> tuple:
        costs = [-1 if v is None else v[0] + self.base for v in self.vector]
        ranks = [-1 if v is None else v[1] for v in self.vector]
        known = (self.size, f"{self.first or ' '}{self.last or ' '}", self.illegal, self.first_turn, self.last_turn, self.min_turn, self.turns)
        return (self.conv_id, self.number, *known, *self.faults[1:], costs, ranks)


@remembered
def _least_of(vector: Vector, step: Step) -> int:
    return min(v[0] + s[0] for i, v in enumerate(vector) if v for s in step[i % 4] if s)


def number_rows(chunk_rows: int, chunk_bytes: int, rows: pa.Schema, summary: pa.Schema):
    """Give the rows of a sorted partition chunk and place; a summary follows each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, open_ = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            done, chunks, places = [], [], []
            names = ("conv_id", "turn", "role", "fault")
            lengths = pa.compute.binary_length(batch.column("text")).to_pylist()
            for conv_id, turn, role, fault, length in zip(*[batch.column(n).to_pylist() for n in names], lengths):
                if open_ is not None and (conv_id != open_.conv_id or open_.size >= chunk_rows or open_.bytes >= chunk_bytes):
                    done.append(open_.row())
                    open_ = None
                if open_ is None:
                    open_, made = Chunk(conv_id, base + made), made + 1
                chunks.append(open_.number)
                places.append(open_.size)
                open_.add(turn, role[:1], fault, length)
            columns = [*batch.columns, pa.array(chunks, pa.int64()), pa.array(places, pa.int32())]
            yield _padded(pa.RecordBatch.from_arrays(columns, schema=rows), summary)
            if done:
                yield _summaries(done, summary)
        if open_ is not None:
            yield _summaries([open_.row()], summary)

    return run


def _padded(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    columns = [batch.column(f.name) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _summaries(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    names = ["conv_id", "chunk", *[f.name for f in schema][7:]]
    kinds = [schema.field(n).type for n in names]
    return _padded(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names), schema)


_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plan_chunks(schema: pa.Schema):
    """States before and after each chunk; the last chunk of a conversation also bears its totals and closes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for _conv, chunks in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: (r["conv_id"],)):
            chunks = list(chunks)
            steps = [_chunk_step(c["costs"], c["ranks"]) for c in chunks]
            front = only(NOTHING)
            for step in steps:
                front = _forward(front, step)
            states = crossings(steps, NOTHING, final_state(front), rows=False)
            cost = sum(step[p][q][0] for step, p, q in zip(steps, states, states[1:])) + TRAILING[states[-1]] * INSERT_COST
            turns, illegal = sum(c["turns"] for c in chunks), sum(c["illegal"] for c in chunks)
            for a, b in zip(chunks, chunks[1:]):
                turns -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
                illegal += a["initials"][1] + b["initials"][0] not in _LEGAL
            low = min((c["min_turn"] for c in chunks if c["min_turn"] is not None), default=None)
            gaps = 0 if low is None else chunks[-1]["last_turn"] - low + 1 - turns
            totals = (gaps, *[sum(c[n] for c in chunks) for n in ("blank", "duplicate", "truncated")], illegal, cost)
            out = [(c["conv_id"], c["chunk"], p, q, False, *[None] * 6) for c, p, q in zip(chunks, states, states[1:])]
            out[-1] = (*out[-1][:4], True, *totals)
            done += out
            if len(done) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


def _chunk_step(costs: list[int], ranks: list[int]) -> Step:
    pairs = [None if c < 0 else (c, r) for c, r in zip(costs, ranks)]
    return tuple(tuple(pairs[p * 4 : p * 4 + 4]) for p in range(4))


def edit_rows(schema: pa.Schema, batch_rows: int = 2000):
    """The edits of each chunk, solved between the states that are set for it; one row per letter of the audit."""

    def solved(rows: list[dict]) -> Iterator[tuple]:
        first = rows[0]
        steps = [row_step(r["role"][:1] if r["role"][:1] in ("s", "u", "a") else "", r["fault"]) for r in rows]
        states = crossings(steps, first["before"], first["after"], rows=True)
        for row, step, p, q in zip(rows, steps, states, states[1:]):
            place = (row["conv_id"], row["chunk"], row["at"])
            for k, letter in enumerate(step[p][q][1]):
                if letter == INSERT:
                    p = _NEXT[p]
                    yield (*place, k, letter, None, ("user", "assistant")[p == ASSISTANT], "")
                else:
                    role = ("user", "assistant")[q == ASSISTANT] if letter == REROLE else row["role"]
                    yield (*place, k, letter, row["turn"], role, row["text"])
        if first["closes"]:
            state = states[-1]
            for k in range(TRAILING[state]):
                state = _NEXT[state]
                yield (rows[-1]["conv_id"], rows[-1]["chunk"], rows[-1]["at"] + 1, k, INSERT, None, ("user", "assistant")[state == ASSISTANT], "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _chunk, rows in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["chunk"]):
            out += solved(list(rows))
            if len(out) >= batch_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def digest_edits(schema: pa.Schema):
    """Audit and hash of each conversation, from its edits in order, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv_id,), edits in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: (r["conv_id"],)):
            sha, letters, first = hashlib.sha256(), [], True
            for e in edits:
                letters.append(e["edit"])
                if e["edit"] != DELETE:
                    sha.update(f"{'' if first else chr(10)}{e['role']}:{e['text']}".encode())
                    first = False
            out.append((conv_id, "".join(letters), sha.hexdigest()))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


# --------------------------------------------------------------------------
# the operator


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _stream(frame: DataFrame, make: Callable[[pa.Schema], Callable], ddl: str) -> DataFrame:
    return frame.mapInArrow(make(_arrow(frame.sparkSession, ddl)), ddl)


def _text(name: str, frame: DataFrame) -> Column:
    return F.coalesce(own_column(frame, name, "string"), F.lit(" "))


class Repair:
    """The repair of all conversations: ``totals`` per conversation, ``edits`` in the order of the audit."""

    def __init__(self, totals: DataFrame, edits: DataFrame):
        self.totals, self.edits = totals, edits

    @property
    def rows(self) -> DataFrame:
        """The repaired rows ``(conv_id, chunk, at, step, turn, role, text)``; in order by chunk, at and step."""
        return self.edits.filter(F.col("edit") != DELETE).drop("edit")

    def digests(self) -> DataFrame:
        """``(conv_id, audit, repaired_sha256)``.

        A hash must be fed in order, so a conversation is streamed through one
        task; the sort before it spills, and only the audit is held.
        """
        kind = dict(self.edits.dtypes)["conv_id"]
        in_order = self.edits.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "at", "step")
        return _stream(in_order.select("conv_id", "edit", "role", "text"), digest_edits, f"conv_id {kind}, audit string, repaired_sha256 string")


def repair_conversations(frame: DataFrame, chunk_rows: int = 4096, chunk_bytes: int = 16 << 20) -> Repair:
    """Faults of conversations and the cheapest edits that repair them.

    ``frame`` has ``conv_id, turn, role, text``; a null role or text is one
    space, a null ``turn`` comes first, rows with a null ``conv_id`` are one
    conversation.  Rows with equal turns are put in order by role and the
    SHA-256 of the text.  An empty table gives empty tables; texts may be as
    long as a row can be; other columns play no part.

    ``totals`` has ``conv_id, gaps, blank, duplicate, truncated, illegal,
    cost``, ``edits`` a row per edit: ``conv_id, chunk, at, step, edit, turn,
    role, text``, with the role after the edit and, for inserts, an empty text.
    """
    kind = dict(frame.dtypes).get("conv_id", "bigint")
    rows = frame.select(own_column(frame, "conv_id", kind).alias("conv_id"), own_column(frame, "turn", "bigint").alias("turn"), _text("role", frame).alias("role"), _text("text", frame).alias("text"))
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    shape = F.when(shown == "", BLANK).when(F.right(shown, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    rows = kept(rows.select(F.monotonically_increasing_id().alias("id"), "*", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), shape.alias("shape")))

    # Of rows with one role and text, all but the first are duplicates: found by a grouping, not by bringing them together.
    firsts = rows.groupBy("conv_id", "role", "sha").agg(F.min(F.struct("turn", "id")).alias("first"))
    flagged = joined(rows, firsts, ["conv_id", "role", "sha"])
    again = F.struct("turn", "id") != F.col("first")
    fault = F.when(F.col("shape") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("shape"))
    in_order = flagged.select("conv_id", "turn", "role", "text", fault.alias("fault"), "sha", "id")
    key = ["conv_id", "turn", "role", "sha", "id"]
    in_order = in_order.repartitionByRange(*key).sortWithinPartitions(*key).drop("sha", "id")

    row_ddl = _ROWS.format(id=kind)
    ddl = f"{row_ddl}, {_SUMMARY}"
    numbered = kept(_stream(in_order, lambda schema: number_rows(chunk_rows, chunk_bytes, _arrow(frame.sparkSession, row_ddl), schema), ddl))
    summaries = numbered.filter("size IS NOT NULL").select("conv_id", "chunk", *[c.split()[0] for c in _SUMMARY.split(", ")])
    # A row per chunk, so even the longest conversation is short here.
    summaries = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    planned = kept(_stream(summaries, plan_chunks, f"conv_id {kind}, chunk bigint, before int, after int, closes boolean, " + ", ".join(f"{t} bigint" for t in _TOTALS)))

    plan = planned.select("chunk", "before", "after", "closes")
    of_chunk = numbered.filter("size IS NULL").select("conv_id", "chunk", "at", "turn", "role", "text", "fault").join(plan, "chunk")
    of_chunk = of_chunk.repartition("chunk").sortWithinPartitions("chunk", "at")
    edits = _stream(of_chunk, edit_rows, f"conv_id {kind}, chunk bigint, at int, step int, edit string, turn bigint, role string, text string")
    return Repair(planned.filter("closes").select("conv_id", *_TOTALS), edits)


def damaged(frame: DataFrame) -> DataFrame:
    """Conversations with faults planted by ``crc32(conv_id:turn) % 20``: rows dropped, emptied, cut, repeated, given to the user."""
    part = lambda name, kind: F.coalesce(own_column(frame, name, kind).cast("string"), F.lit(" "))
    kind = dict(frame.dtypes).get("conv_id", "bigint")
    case = F.crc32(F.encode(F.concat(part("conv_id", kind), F.lit(":"), part("turn", "bigint")), "UTF-8")) % 20
    rows = frame.select(
        own_column(frame, "conv_id", kind).alias("conv_id"), own_column(frame, "turn", "bigint").alias("turn"), _text("role", frame).alias("role"), _text("text", frame).alias("text"), case.alias("case")
    )
    return rows.filter("case <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("case") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repaired_damage(frame: DataFrame) -> DataFrame:
    """Damage all conversations and repair them: one row per ``conv_id`` of ``frame``, also of those nothing is left of."""
    repair = repair_conversations(damaged(frame))
    done = joined(repair.totals, kept(repair.digests()), ["conv_id"])
    kind = dict(frame.dtypes).get("conv_id", "bigint")
    all_ = frame.select(own_column(frame, "conv_id", kind).alias("conv_id")).distinct()
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    rows = joined(all_, done, ["conv_id"], "left")
    return rows.select(
        "conv_id", *[F.coalesce(t, F.lit(0).cast("bigint")).alias(t) for t in _TOTALS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )
