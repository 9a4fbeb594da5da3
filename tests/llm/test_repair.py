"""Conversation repair against a search over what is left of a conversation, from its end."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from foliospark.llm import repair

SCHEMA = StructType([
    StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType()),
    *(StructField(c, StringType()) for c in ("kind", "part", "place", "digest", "plan", "cost", "steps", "n", "copy")),
])
SPACES = re.compile(r"[\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def fault(rows, i):
    _, _, role, text = rows[i]
    shown = SPACES.sub("", text)
    if not shown:
        return "blank"
    if any(r[2:] == (role, text) for r in rows[:i]):
        return "duplicate"
    return "truncated" if shown[-1] not in ".!?" else None


def cheapest(initials, faults):
    """(cost, audit) by what is left: of rows i and later, after the output state; inserted rows come at most twice in a row."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserted):
        options = []
        if i == len(initials) and state in ("", "a"):
            options.append((0, ""))
        if inserted < 2:
            for c in "ua":
                if (state, c) in step:
                    cost, audit = best(i, step[state, c], inserted + 1)
                    options.append((cost + 3, "I" + audit))
        if i < len(initials):
            cost, audit = best(i + 1, state, 0)
            options.append((cost + 4, "D" + audit))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for c, price, letter in ((initials[i], 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                    if (state, c) in step:
                        cost, audit = best(i + 1, step[state, c], 0)
                        options.append((cost + price + more, letter + audit))
        return min(options, default=(10**9, ""))

    return best(0, "", 0)


def expected(conv, rows):
    rows = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    faults = [fault(rows, i) for i in range(len(rows))]
    initials = [r[2][:1] or " " for r in rows]
    cost, audit = cheapest(tuple(initials), tuple(faults))
    turns = {r[1] for r in rows} - {None}
    out, state, at = [], "", 0
    for e in audit:
        new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        if e == "I":
            out.append((new, ""))
        else:
            if e == "K":
                out.append(rows[at][2:])
            if e == "R":
                out.append((new, rows[at][3]))
            at += 1
        state = out[-1][0][0] if out else ""
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return (
        str(conv), max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def check(df, data):
    got = [tuple([str(r.conv_id), *r[1:]]) for r in repair.repair_report(df).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    rows = damaged([r[:4] for r in data])
    assert sorted(got) == sorted(expected(c, rows) for c in {r[0] for r in data})


def awkward(seed=1):
    rng = random.Random(seed)
    said = ["Hello there.", "Yes!", "no", "Why?", "", " \n", "ok", "fine…", "Done. ", "日本。", "x" * 5000 + ".", None, "a\nb."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "user", "assistant"]
    out = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([0, 1, 2, 3, 6, 9])):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            out.append((conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1), role, rng.choice(said)))
    out += out[:7]  # whole rows twice
    return [(*r, *("x",) * 9) for r in out]


def test_awkward_conversations(spark):
    data = awkward()
    check(spark.createDataFrame(data, SCHEMA).repartition(3), data)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    check(df, [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_empty_and_wholly_dropped(spark):
    assert repair.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair_report(spark.createDataFrame([(conv, 0, "user", "Hi.", *("",) * 9)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def long_conversation(n, seed=8):
    rng = random.Random(seed)
    return [(7, t + t // 50, rng.choice(["user", "assistant", "system"] if t % 9 == 0 else [("user", "assistant")[t % 2]]), f"text {rng.randrange(n)}" + rng.choice("..,")) for t in range(n)]


@pytest.mark.parametrize("block_rows", [1, 3, 16])
def test_blocks_join_to_the_whole(spark, block_rows):
    data = damaged(long_conversation(150))
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    plans = repair.repair_plans(rows, block_rows=block_rows)
    got = [(str(r[0]), *r[1:]) for r in repair.digests(rows, plans).collect()]
    assert got == [expected(7, data)]


def test_long_conversation_is_spread(spark):
    rows = spark.createDataFrame(long_conversation(4000), "conv_id long, turn long, role string, text string").repartition(8)
    features = repair._features(rows, rows.select("conv_id").distinct())
    order = repair._order()
    blocks = repair._blocks(features.repartitionByRange(8, "conv_id", *order).sortWithinPartitions("conv_id", *order), 64).collect()
    assert len({b.part for b in blocks}) == 8 and max(sum(c.audit.count("K") for c in b.steps if c.start == "") for b in blocks) <= 4 * 64


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (2, 0, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    got = repair.repaired_rows(rows, repair.repair_plans(rows)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Again."), (2, 0, "user", ""), (2, 1, "assistant", "Yes.")]


def test_agenda_is_the_lightest_on_random_rows():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(0, 8)
        initials = [rng.choice("suat ") for _ in range(n)]
        faults = [rng.choice([None, None, "blank", "duplicate", "truncated"]) for _ in range(n)]
        ends = repair.lightest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)], "")
        assert min(ends[q] for q in repair.GOALS if q in ends) == cheapest(tuple(initials), tuple(faults))
