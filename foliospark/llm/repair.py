"""Conversation structure repair by lightest derivations.

A conversation is put right when its role initials read ``(s?(ua)+)?``.  Its rows are kept, given another role, deleted, or
joined by inserted empty ones; the cheapest list of edits is wanted, and of equally cheap ones the first in ASCII order.

An item says that the first i rows are dealt with and which initial came last.  A deduction takes an item and a row (an
axiom of weight nothing) to a further item, or inserts; its function adds the edit's cost and letter to the weight
(cost, audit).  Such a function never makes a weight smaller and keeps the order of weights: two audits of one item and one
cost hold equally many edits, so neither begins the other.  Knuth's agenda may therefore take the lightest open item as
final, each once, and stop at its goals.

Long conversations are cut into blocks of ``BLOCK_ROWS``.  A block runs its agenda once for each initial that may come
before it, and returns the lightest weights from initial to initial; the blocks of a conversation are then joined in order
by the same functions, and the goal is the lighter of its two ends.  Row features are sorted by ranges, so a conversation
of a third of all rows is spread over tasks; texts are shuffled once, for the digest of the repaired conversation, which
has to be read in order and is streamed.

Rows are taken by turn, nulls first, then by role, then by digest of the text.  A null role or text counts as one space,
an empty role's initial as a space.  Conversations may have a null id.  Conversations without rows, given in ``ids``, have
zeros, an empty audit and the digest of nothing.  Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

RETITLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs
BLOCK_ROWS = 256
ROLES = {"u": "user", "a": "assistant"}
#: What may follow the last initial; nothing has come before the empty one.
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
GOALS = ("", "a")
SPACE = " \t\n\x0b\f\r"
#: Rows of an Arrow batch of results.
BATCH_ROWS = 2_000


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the checksum of ``conv_id:turn``: dropped, emptied, without stops, repeated,
    or from another role.  Nulls count as one space, in the key too."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", shown[2].alias("role"), shown[3].alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


# --- the agenda ---


def lightest(rows: list[tuple[str, bool, bool]], entry: str) -> dict[str, tuple[int, str]]:
    """Lightest (cost, audit) of dealing with all rows, by the initial that then came last.

    A row is (initial, must be deleted, truncated); ``entry`` is the initial before the first row."""
    n = len(rows)
    agenda = [(0, "", 0, entry)]
    final, goals = set(), {}
    while agenda and len(goals) < len(FOLLOWS):
        cost, audit, i, last = heapq.heappop(agenda)
        if (i, last) in final:
            continue
        final.add((i, last))
        if i == n:
            goals[last] = (cost, audit)
        allowed = FOLLOWS[last]
        for role in ROLES:
            if role in allowed:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", i, role))
        if i == n:
            continue
        initial, gone, cut = rows[i]
        heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, last))
        if gone:
            continue
        kept = cost + TRUNCATED * cut
        if initial in allowed:
            heapq.heappush(agenda, (kept, audit + "K", i + 1, initial))
        for role in ROLES:
            if role in allowed and role != initial:
                heapq.heappush(agenda, (kept + RETITLE, audit + "R", i + 1, role))
    return goals


def joined(before: dict[str, tuple[int, str]], steps: list[tuple[str, str, int, str]]) -> dict[str, tuple[int, str]]:
    """Lightest weights after a further block, from those before it and the block's (from, to, cost, audit)."""
    after: dict[str, tuple[int, str]] = {}
    for start, end, cost, audit in steps:
        if start in before:
            weight = (before[start][0] + cost, before[start][1] + audit)
            if end not in after or weight < after[end]:
                after[end] = weight
    return after


def edited(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of a repaired conversation, from its rows in order and the letters of its edits."""
    last = ""
    for edit in audit:
        if edit == "I":
            role, text = ROLES[FOLLOWS[last][-1]], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES[FOLLOWS[last][-1]]
        last = role[:1]
        yield role, text


# --- row features ---


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def _features(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, blank, cut, first, n): equal rows in one with their number; a row with n = 0 opens
    every conversation."""
    text = F.rtrim(F.col("text"), F.lit(SPACE))
    some = rows.select(
        "conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), (text == "").alias("blank"),
        (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("cut"), F.lit(1).alias("n"))
    opening = ids.select(
        "conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"),
        F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(0).alias("n"))
    some = some.unionByName(opening).groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.sum("n").alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = some.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = some.conv_id.eqNullSafe(first.c) & (some.role == first.r) & (some.digest == first.d)
    return some.join(first, same).select(
        "conv_id", "turn", "role", "digest", "blank", "cut", turn.eqNullSafe(F.col("first")).alias("first"), "n")


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_STEPS = pa.list_(pa.struct([("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


class _Block:
    """Counts and rows of one run of rows of a conversation."""

    def __init__(self, opening: bool):
        self.opening, self.rows = opening, []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = None
        self.turns = 0

    def add(self, initial: str, turn: int | None, blank: bool, duplicate: bool, cut: bool) -> None:
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if cut else None
        if fault:
            self.counts[fault] += 1
        if self.rows and self.rows[-1][0] + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.rows.append((initial, blank or duplicate, fault == "truncated"))
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def record(self) -> dict:
        steps = [
            {"start": start, "end": end, "cost": cost, "audit": audit}
            for start in (("",) if self.opening else FOLLOWS)
            for end, (cost, audit) in lightest(self.rows, start).items()
        ]
        ends = (self.rows[0][0], self.rows[-1][0]) if self.rows else (None, None)
        return {"first": ends[0], "last": ends[1], "low": self.low, "high": self.high, "turns": self.turns, **self.counts, "steps": steps}


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batched(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for record in records:
        held.append(record)
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    return df.select(column).limit(0).toArrow().schema.field(0).type


def _blocks(features: DataFrame, block_rows: int) -> DataFrame:
    """One row per block, in the order (part, place) within its conversation."""
    conv_type, turn_type = _arrow(features, "conv_id"), _arrow(features, "turn")
    fields = [("conv_id", conv_type), ("part", pa.int32()), ("place", pa.int64()), ("first", pa.string()), ("last", pa.string())]
    fields += [("low", turn_type), ("high", turn_type), *((c, pa.int64()) for c in ("turns", *_COUNTS)), ("steps", _STEPS)]
    schema = pa.schema(fields)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        for conv_id, rows in groupby(_tuples(batches), itemgetter(0)):
            block = None
            for _, turn, initial, blank, cut, first, n in rows:
                if block is None:  # a conversation without its opening row is carried on from the partition before
                    block = _Block(opening=n == 0)
                for i in range(n):
                    if len(block.rows) == block_rows:
                        yield {"conv_id": conv_id, "part": part, "place": place, **block.record()}
                        block, place = _Block(opening=False), place + 1
                    block.add(initial, turn, blank, i > 0 or not first, cut)
            yield {"conv_id": conv_id, "part": part, "place": place, **block.record()}
            place += 1

    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    rows = features.select("conv_id", "turn", initial.alias("initial"), "blank", "cut", "first", "n")
    kinds = {c: features.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    out = f"conv_id {kinds['conv_id']}, part int, place long, first string, last string, low {kinds['turn']}, high {kinds['turn']}, turns long, "
    out += "".join(f"{c} long, " for c in _COUNTS) + "steps array<struct<start:string, end:string, cost:long, audit:string>>"
    return rows.mapInArrow(lambda batches: _batched(records(batches), schema), out)


def repair_plans(rows: DataFrame, ids: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text) and of ``ids`` (conv_id): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit.  Roles and texts must not be null."""
    every = rows.select("conv_id") if ids is None else rows.select("conv_id").unionByName(ids.select("conv_id"))
    order = [F.asc_nulls_first("conv_id"), *_order()]
    features = _features(rows, every.distinct()).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = durable(_blocks(features, block_rows), "repair-blocks")
    fields = [("conv_id", _arrow(rows, "conv_id")), *((c, pa.int64()) for c in ("gaps", *_COUNTS, "cost")), ("audit", pa.string())]
    schema = pa.schema(fields)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv_id, group in groupby(_tuples(batches), itemgetter(0)):
            weights, counts, turns = {"": (0, "")}, [0] * len(_COUNTS), 0
            last = low = high = None
            for _, _, _, first, end, start_turn, end_turn, n, *more, steps in group:
                weights = joined(weights, [tuple(s[k] for k in ("start", "end", "cost", "audit")) for s in steps])
                counts = [x + y for x, y in zip(counts, more)]
                if first is not None:
                    counts[-1] += last is not None and last + first not in ("su", "ua", "au")
                    last = end
                if n:
                    turns += n - (start_turn == high)
                    low, high = start_turn if low is None else low, end_turn
            cost, audit = min(weights[q] for q in GOALS if q in weights)
            gaps = high - low + 1 - turns if turns else 0
            yield {"conv_id": conv_id, "gaps": gaps, **dict(zip(_COUNTS, counts)), "cost": cost, "audit": audit}

    blocks = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = ", ".join([f"conv_id {kind}", *(f"{c} long" for c in ("gaps", *_COUNTS, "cost")), "audit string"])
    return blocks.mapInArrow(lambda batches: _batched(records(batches), schema), out)


def _followed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Every plan and after it, in the same partition, the rows of its conversation in order."""
    names = [c for c in plans.columns if c != "conv_id"]
    plan = F.struct(*names)
    heads = plans.select("conv_id", F.lit(0).alias("kind"), plan.alias("plan"))
    lines = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), "text")
    both = heads.unionByName(lines, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", *_order()).select("conv_id", "plan", "role", "text")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, plan, repaired (role, text) rows) of each conversation; its rows must be read before the next one's."""
    for conv_id, group in groupby(_tuples(batches), itemgetter(0)):
        plan = next(group)[1]
        yield conv_id, plan, edited(((role, text) for _, _, role, text in group), plan["audit"])


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, row by row."""
    schema = pa.schema([("conv_id", _arrow(rows, "conv_id")), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv_id, _, lines in _repaired(batches):
            for place, (role, text) in enumerate(lines):
                yield {"conv_id": conv_id, "place": place, "role": role, "text": text}

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _followed(rows, plans).mapInArrow(lambda b: _batched(records(b), schema), f"conv_id {kind}, place long, role string, text string")


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans, with the digest of each repaired conversation: its rows as ``role:text``, joined by line feeds."""
    names = [*(c for c in plans.columns if c != "conv_id"), "repaired_sha256"]
    types = [pa.string() if c in ("audit", "repaired_sha256") else pa.int64() for c in names]
    schema = pa.schema([("conv_id", _arrow(rows, "conv_id")), *zip(names, types)])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv_id, plan, lines in _repaired(batches):
            digest = hashlib.sha256()
            for place, (role, text) in enumerate(lines):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield {"conv_id": conv_id, **plan, "repaired_sha256": digest.hexdigest()}

    kind = rows.schema["conv_id"].dataType.simpleString()
    out = ", ".join([f"conv_id {kind}", *(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in zip(names, types))])
    return _followed(rows, plans).mapInArrow(lambda batches: _batched(records(batches), schema), out)


def repair_report(conversations: DataFrame) -> DataFrame:
    """The registered query: damage, plan and repair every conversation."""
    rows = damage(conversations)
    plans = durable(repair_plans(rows, conversations.select("conv_id").distinct()), "repair-plans")
    return digests(rows, plans)
