"""Repair of conversation structure at least cost, by divide and conquer over four states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import hot_join

# What may be left: nothing, or a system turn at most and then user and assistant in turn.
# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = 4
# What an insertion or a new role gives in each state, and the state after it
NEXT = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Insertions that end a conversation, by state
CLOSING = ("", "II", "I", "")
# Kinds of rows: 0 has to go; else by initial (s, u, a, other) and whether cut short
INITIALS = "sua"
KINDS = 9
# Rows of a segment, one task's unit of work in a long conversation
SEGMENT = 4096
SPACES = " \t\n\x0b\x0c\r"
FAR = 1 << 60
# A step: (state before, state after, cost, order among those from the same state)
Step = tuple[int, int, int, int]


def _row_steps(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest edits (ties: ASCII-least) that take a row from one state to another."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    initial, cut = (None, 0) if kind == 0 else ((*INITIALS, None)[(kind - 1) // 2], (kind - 1) % 2)
    for before in range(STATES):
        state, edits, cost = before, "", 0
        for _ in range(STATES):  # more insertions come round to the same state
            ways = [(state, DELETE, "D")]
            if kind:
                ways.append((AFTER[state], REROLE + TRUNCATED * cut, "R"))
                if initial == NEXT[state][0]:
                    ways.append((AFTER[state], TRUNCATED * cut, "K"))
                elif initial == "s" and state == 0:
                    ways.append((1, TRUNCATED * cut, "K"))
            for after, paid, edit in ways:
                way = (cost + paid, edits + edit)
                if way < best.get((before, after), (FAR, "")):
                    best[before, after] = way
            state, edits, cost = AFTER[state], edits + "I", cost + INSERT
    return best


def _ordered(best: dict[tuple[int, int], tuple[int, str]]) -> list[Step]:
    steps = []
    for before in range(STATES):
        own = sorted((way[1], after, way[0]) for (b, after), way in best.items() if b == before)
        steps += [(before, after, cost, at) for at, (_, after, cost) in enumerate(own)]
    return steps


ROW_EDITS = [_row_steps(kind) for kind in range(KINDS)]
ROW_STEPS = [_ordered(best) for best in ROW_EDITS]
END_COST = [INSERT * len(edits) for edits in CLOSING]


def only(state: int) -> list[int]:
    return [0 if s == state else FAR for s in range(STATES)]


def forward(costs: list[int], ranks: list[int], steps: list[Step]) -> tuple[list[int], list[int]]:
    """Least costs by state after ``steps``, and the order of the cheapest, ASCII-least edits to them.

    Edits up to a row end with what is done to that row, so of two different ones none begins
    the other, and their order stays whatever follows.
    """
    best: list = [(FAR, 0, 0)] * STATES
    for before, after, cost, order in steps:
        way = (costs[before] + cost, ranks[before], order)
        if way < best[after]:
            best[after] = way
    places = sorted((rank, order, s) for s, (_, rank, order) in enumerate(best))
    out = [0] * STATES
    for place, (_, _, s) in enumerate(places):
        out[s] = place
    return [min(cost, FAR) for cost, _, _ in best], out


def backward(costs: list[int], steps: list[Step]) -> list[int]:
    """Least costs by state before ``steps`` from those after them."""
    out = [FAR] * STATES
    for before, after, cost, _ in steps:
        out[before] = min(out[before], cost + costs[after])
    return out


def crossings(items: list[list[Step]], start: int, end: list[int]) -> list[int]:
    """State after each item of the cheapest way, the ASCII-least of those that cost the same.

    Costs run forward from the start and backward from the end and meet in the middle, where the
    state of least cost is chosen, ties by the order of the edits up to it;
    then each half is done alike. So there are two vectors of four states at a time, never a
    table of them for all rows.
    """
    states = [0] * len(items)
    todo = [(0, len(items), start, end)]
    while todo:
        low, high, begin, final = todo.pop()
        middle = (low + high + 1) // 2
        costs, ranks = only(begin), [0] * STATES
        for item in items[low:middle]:
            costs, ranks = forward(costs, ranks, item)
        rest = final
        for item in reversed(items[middle:high]):
            rest = backward(rest, item)
        state = min(range(STATES), key=lambda s: (costs[s] + rest[s], ranks[s]))
        states[middle - 1] = state
        if middle - low > 1:
            todo.append((low, middle, begin, only(state)))
        if high > middle:
            todo.append((middle, high, state, final))
    return states


def span_steps(kinds: list[int]) -> list[Step]:
    """A run of rows as one step from each state to each other."""
    out = []
    for before in range(STATES):
        costs, ranks = only(before), [0] * STATES
        for kind in kinds:
            costs, ranks = forward(costs, ranks, ROW_STEPS[kind])
        out += [(before, after, costs[after], ranks[after]) for after in range(STATES) if costs[after] < FAR]
    return out


# --- DataFrame steps ------------------------------------------------------------


def damage_turns(convs: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults by crc32(``conv_id:turn``) modulo 20.

    Nulls are one space in that name, as roles and as texts. 0 drops a row, 1 empties its text,
    2 takes its stops away, 3 repeats it, 4 makes its role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    times = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return convs.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted rows of a partition and cut each conversation into segments."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    none = object()
    conv, size, segment, row = none, 0, part << 32, part << 40
    for batch in batches:
        segs, places = [], []
        for own in batch.column(0).to_pylist():
            if own != conv or size == SEGMENT:
                conv, size, segment = own, 0, segment + 1
            size, row = size + 1, row + 1
            segs.append(segment)
            places.append(row)
        columns = [*batch.columns, pa.array(segs, pa.int64()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "seg", "pos"])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows that follow each other with the same key."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


_SPAN = "conv long, seg long, first long, illegal long, head string, tail string, steps array<int>"
_SPAN_ARROW = pa.schema(
    [
        ("conv", pa.int64()), ("seg", pa.int64()), ("first", pa.int64()), ("illegal", pa.int64()),
        ("head", pa.string()), ("tail", pa.string()), ("steps", pa.list_(pa.int32())),
    ]
)
LEGAL = {"su", "ua", "au"}


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for run in _runs(batches, "seg"):
            heads = [r["initial"] for r in run]
            yield {
                "conv": run[0]["conv"], "seg": run[0]["seg"], "first": run[0]["pos"],
                "illegal": sum(a + b not in LEGAL for a, b in zip(heads, heads[1:], strict=False)),
                "head": heads[0], "tail": heads[-1],
                "steps": [x for step in span_steps([r["kind"] for r in run]) for x in step],
            }

    return _batched(rows(), _SPAN_ARROW)


_ROUTE = "conv long, seg long, begin int, end int, last boolean, illegal long, cost long"
_ROUTE_ARROW = pa.schema(
    [
        ("conv", pa.int64()), ("seg", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()),
        ("last", pa.bool_()), ("illegal", pa.int64()), ("cost", pa.int64()),
    ]
)


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States between the segments of each conversation."""

    def rows() -> Iterator[dict]:
        for run in _runs(batches, "conv"):
            items = [list(zip(*[iter(r["steps"])] * 4, strict=True)) for r in run]
            begin, tail = 0, None
            for n, (row, item, end) in enumerate(zip(run, items, crossings(items, 0, END_COST), strict=True)):
                last = n == len(run) - 1
                cost = next(c for a, b, c, _ in item if (a, b) == (begin, end))
                yield {
                    "conv": row["conv"], "seg": row["seg"], "begin": begin, "end": end, "last": last,
                    "illegal": row["illegal"] + (tail is not None and tail + row["head"] not in LEGAL),
                    "cost": cost + (END_COST[end] if last else 0),
                }
                begin, tail = end, row["tail"]

    return _batched(rows(), _ROUTE_ARROW)


_EDIT = "conv long, pos long, uid long, edit string, role string, before array<string>, after array<string>"
_EDIT_ARROW = pa.schema(
    [
        ("conv", pa.int64()), ("pos", pa.int64()), ("uid", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
        ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string())),
    ]
)


def _inserted(state: int, times: int) -> tuple[int, list[str]]:
    roles = []
    for _ in range(times):
        roles.append(NEXT[state])
        state = AFTER[state]
    return state, roles


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for run in _runs(batches, "seg"):
            items = [ROW_STEPS[r["kind"]] for r in run]
            state = run[0]["begin"]
            ends = crossings(items, state, only(run[0]["end"]))
            for n, (row, end) in enumerate(zip(run, ends, strict=True)):
                edits = ROW_EDITS[row["kind"]][state, end][1]
                state, before = _inserted(state, len(edits) - 1)
                closes = row["last"] and n == len(run) - 1
                yield {
                    "conv": row["conv"], "pos": row["pos"], "uid": row["uid"], "edit": edits[-1],
                    "role": NEXT[state] if edits[-1] == "R" else None, "before": before,
                    "after": _inserted(end, len(CLOSING[end]))[1] if closes else [],
                }
                state = end

    return _batched(rows(), _EDIT_ARROW)


_DIGEST = "conv long, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and a hash of what is left of each conversation, whose rows come in order."""
    schema = pa.schema([("conv", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def rows() -> Iterator[dict]:
        none = object()
        conv, edits, hashed, first = none, [], hashlib.sha256(), True
        for batch in batches:
            for row in batch.to_pylist():
                if row["conv"] != conv or conv is none:
                    if conv is not none:
                        yield {"conv": conv, "audit": "".join(edits), "repaired_sha256": hashed.hexdigest()}
                    conv, edits, hashed, first = row["conv"], [], hashlib.sha256(), True
                edits.append(row["edit"])
                if row["edit"] != "D":
                    line = f"{row['role']}:{row['text']}"
                    hashed.update((line if first else "\n" + line).encode("utf-8", "surrogatepass"))
                    first = False
        if conv is not none:
            yield {"conv": conv, "audit": "".join(edits), "repaired_sha256": hashed.hexdigest()}

    return _batched(rows(), schema, 200)


class Repair(NamedTuple):
    """``turns``: ``conv_id, pos, sub, edit, role, text`` in the order of ``pos, sub`` (a
    deleted turn has edit D and a null text). ``report``: a row for each conversation."""

    turns: DataFrame
    report: DataFrame


def repair_conversations(turns: DataFrame) -> Repair:
    """Cheapest edits that leave each conversation as system (or not), then user and assistant in turn.

    ``turns`` has ``conv_id, turn, role, text``; null roles and texts are one space, a null
    conversation is one like others, other columns may have any name. Rows go by turn, nulls first, then
    role, then a hash of role and text, so ties give one result. Each row's first fault counts: blank, duplicate
    (role and text seen earlier in the conversation), truncated (its last character but white space is no
    stop). Keeping is free, a new role costs 2, deletion 3 (a blank or a duplicate has to go),
    an insertion 2, and what stays truncated 1. Of equal costs the ASCII-least edits are
    taken. An empty table gives no rows. Texts of any length are handled in the JVM, and hashed as they stream by.

    Rows are sorted by range, so a long conversation lies in many tasks. Each segment of it becomes a
    table of costs from state to state, and the tables of a conversation (one row for ``SEGMENT``
    rows) decide the states between segments; then each segment finds its own
    edits, by the same divide and conquer. Only the digest of a conversation is one stream.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        spaced("role").alias("role"),
        spaced("text").alias("text"),
    )
    stripped = F.rtrim("text", F.lit(SPACES))
    name = F.concat_ws("|", F.coalesce(F.col("conv").cast("string"), F.lit("")), F.length("role"), "role", "text")
    rows = rows.select(
        "*",
        F.monotonically_increasing_id().alias("uid"),
        F.md5(name).alias("digest"),
        (stripped == "").alias("blank"),
        (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    rows = materialize(rows, "turns")
    first = F.min(F.struct("turn", "uid")).alias("first")  # null turns are least
    seen = rows.filter("NOT blank").groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = materialize(seen.select("digest", F.col("first.uid").alias("first")), "repeated-turns")
    light = hot_join(rows.drop("text"), seen, ["digest"], ["uid"], "left")
    again = F.coalesce(F.col("first") != F.col("uid"), F.lit(False)) & ~F.col("blank")
    initial = F.left("role", F.lit(1))
    order = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS)), initial), F.lit(0)).cast("int")
    kind = F.when(F.col("blank") | again, 0).otherwise(
        1 + 2 * F.when(order == 0, len(INITIALS)).otherwise(order - 1) + F.col("cut").cast("int")
    )
    light = light.select("conv", "turn", "role", "digest", "uid", "blank", "cut", again.alias("again"), initial.alias("initial"), kind.alias("kind"))
    by = ["conv", "turn", "role", "digest", "uid"]
    placed = light.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = "conv long, turn long, uid long, initial string, kind int, blank boolean, again boolean, cut boolean"
    placed = placed.select(*[c.split()[0] for c in schema.split(", ")])
    placed = materialize(placed.mapInArrow(_segments, f"{schema}, seg long, pos long"), "placed-turns")

    def in_order(df: DataFrame, key: str, *then: str) -> DataFrame:
        return df.repartition(key).sortWithinPartitions(key, *then)

    spans = in_order(placed.select("conv", "seg", "pos", "kind", "initial"), "seg", "pos").mapInArrow(_spans, _SPAN)
    routes = materialize(in_order(spans, "conv", "first").mapInArrow(_routes, _ROUTE), "routes")
    known = placed.select("conv", "seg", "pos", "uid", "kind").join(
        routes.select("seg", "begin", "end", "last").hint("merge"), "seg"
    )
    edits = materialize(in_order(known, "seg", "pos").mapInArrow(_edits, _EDIT), "edits")

    made = lambda roles: F.transform(roles, lambda r: _turn(F.lit("I"), r, F.lit("")))
    gone = F.col("edit") == "D"
    own = _turn(F.col("edit"), F.coalesce("new_role", "role"), F.when(~gone, F.col("text")))
    texts = rows.select("uid", "role", "text").hint("merge")
    repaired = edits.withColumnRenamed("role", "new_role").join(texts, "uid")
    repaired = repaired.select(
        "conv", "pos", F.posexplode(F.concat(made("before"), F.array(own), made("after"))).alias("sub", "turn")
    ).select("conv", "pos", "sub", "turn.*")
    repaired = materialize(repaired, "repaired-turns")
    digests = in_order(repaired, "conv", "pos", "sub").mapInArrow(_digests, _DIGEST)
    return Repair(repaired.withColumnRenamed("conv", "conv_id"), _report(placed, routes, digests))


def _turn(edit: Column, role: Column, text: Column) -> Column:
    return F.struct(edit.alias("edit"), role.alias("role"), text.alias("text"))


def _report(placed: DataFrame, routes: DataFrame, digests: DataFrame) -> DataFrame:
    wide = lambda f: f("turn").cast("decimal(20,0)")
    turns = placed.groupBy("conv", "turn").agg(
        F.count_if("blank").alias("blank"),
        F.count_if("again").alias("duplicate"),
        F.count_if(F.col("cut") & ~F.col("blank") & ~F.col("again")).alias("truncated"),
    )
    gaps = F.coalesce(wide(F.max) - wide(F.min) + 1 - F.count("turn"), F.lit(0).cast("decimal(20,0)"))
    facts = turns.groupBy("conv").agg(
        F.least(gaps, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    costs = routes.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    # one row of each for a conversation; a null one has its row too
    parts = facts.unionByName(costs, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    merged = parts.groupBy("conv").agg(*[F.max(c).alias(c) for c in names])
    return merged.withColumnRenamed("conv", "conv_id")


def conversation_report(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The report on ``turns`` with a row for every conversation of ``convs``.

    One without turns has zeros, no edits and the hash of nothing.
    """
    report = repair_conversations(turns).report
    every = convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    parts = report.unionByName(every, allowMissingColumns=True)
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(nothing.get(c, 0))).alias(c) for c in report.columns[1:]]
    )
