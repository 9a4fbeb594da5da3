"""The dispatch plan against a sequential pass per client, and the limits in every span of a minute."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from foliospark.config import ConfigError
from foliospark.operators.pacing import MINUTE, dispatch_plan

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "client string, ts timestamp, request_id long, tokens long"


def log(seed, n, clients=("a", "b", None)):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        at += rng.choice([0, 0, 0.5, 3, 40, 400])
        tokens = rng.choice([0, 10, 300, 800, 1200, 1900, 2500, None])
        when = None if rng.random() < 0.02 else START + dt.timedelta(seconds=at)
        rows.append((rng.choices(clients, [8, 1, 1])[0], when, i, tokens))
    rng.shuffle(rows)
    return rows


def micros(t):
    return None if t is None else (t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def sequential(rows, token_limit, request_limit):
    ordinary = [r[3] or 0 for r in rows if (r[3] or 0) <= token_limit // 2]
    rate = token_limit - max(ordinary, default=0)
    free, out = defaultdict(lambda: float("-inf")), {}
    for client, ts, request, tokens in sorted(rows, key=lambda r: (r[1] is not None, r[1] or START, r[2])):
        tokens = tokens or 0
        if tokens > token_limit:
            out[request] = None
            continue
        alone = tokens > token_limit // 2
        share = MINUTE if alone else max(-(-tokens * MINUTE // rate), -(-MINUTE // request_limit))
        at = max(micros(ts) or 0, free[client] + (MINUTE if alone else 0))
        free[client], out[request] = at + share, at
    return out


@pytest.mark.parametrize("seed, bucket", [(1, 3600), (2, 60), (3, 7)])
def test_plan_equals_a_sequential_pass_and_keeps_the_limits(spark, seed, bucket):
    rows = log(seed, 700)
    plan = dispatch_plan(spark.createDataFrame(rows, SCHEMA).repartition(4), 2_000, 4, bucket).selectExpr("*", "unix_micros(dispatch_at) AS at").collect()
    want = sequential(rows, 2_000, 4)
    assert {r.request_id: r.at for r in plan} == want and len(plan) == len(rows)
    assert {r.request_id for r in plan if r.over_limit} == {r[2] for r in rows if (r[3] or 0) > 2_000}
    sent = defaultdict(list)
    for r in plan:
        if r.at is not None:
            assert r.ts is None or r.at >= (micros(r.ts.astimezone(dt.timezone.utc)) if r.ts.tzinfo else r.at)
            sent[r.client].append((r.at, r.tokens or 0))
    for requests in sent.values():
        requests.sort()
        for i, (at, _) in enumerate(requests):
            span = [t for when, t in requests[i : i + 50] if when < at + MINUTE]
            assert sum(span) <= 2_000 and len(span) <= 4


def test_busy_client_is_many_tasks(spark):
    rows = [("hot", START + dt.timedelta(seconds=i), i, 5) for i in range(4000)]
    plan = dispatch_plan(spark.createDataFrame(rows, SCHEMA), 1_000, 60, 100)
    text = plan._jdf.queryExecution().toString()
    assert "hashpartitioning(client" in text and "_bucket" in text
    assert {r.request_id: r.at for r in plan.selectExpr("request_id", "unix_micros(dispatch_at) AS at").collect()} == sequential(rows, 1_000, 60)


def test_empty_log_and_bad_limits(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert dispatch_plan(nothing, 100, 1).count() == 0
    with pytest.raises(ConfigError):
        dispatch_plan(nothing, 100, 0)
