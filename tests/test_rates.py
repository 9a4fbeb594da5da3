from pyspark.sql import functions as F

from foliospark.functions import rates
from foliospark.functions.tokens import ArrowTokenCounter, TokenCounter
from foliospark.operators.ordered import lag_value, running_sum

def at():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def parse(spark, headers):
    m = F.create_map(*[F.lit(x) for kv in headers.items() for x in kv]) if headers else F.create_map().cast("map<string,string>")
    return spark.range(1).select(rates.parse_rate_headers(m, at()).alias("s")).first().s


def test_headers(spark):
    s = parse(spark, {rates.H_LEFT_REQUESTS: " 172799 ", rates.H_LEFT_TOKENS: "1_000", rates.H_RESET_TOKENS: "2.5"})
    assert (s.requests_remaining, s.tokens_remaining, s.headers_parsed) == (172799, 1000, True)
    assert (s.reset_time - s.last_updated).total_seconds() == 2.5
    assert (s.requests_reset_time - s.last_updated).total_seconds() == 86400
    for odd in ("1d", "2.5f", "0x1p3", "nan", "", "1__0"):
        assert not parse(spark, {rates.H_RESET_TOKENS: odd}).headers_parsed, odd
    for fine, secs in ((" 1e1 ", 10), ("1_0.5", 10.5), ("-3", -3), (".5", 0.5)):
        s = parse(spark, {rates.H_RESET_TOKENS: fine})
        assert s.headers_parsed and (s.reset_time - s.last_updated).total_seconds() == secs
    for n, want in (("+5", 5), ("-7", -7), ("12.5", None), ("1e3", None), ("5_0", 50), ("_5", None), ("", None)):
        s = parse(spark, {rates.H_LEFT_TOKENS: n})
        assert (s.tokens_remaining if s.headers_parsed else None) == want, n
    for bad in ({rates.H_RESET_TOKENS: "-Infinity", rates.H_LEFT_TOKENS: "5"}, {rates.H_LEFT_REQUESTS: "invalid", rates.H_LEFT_TOKENS: "5"}, {rates.H_RESET_TOKENS: "inf", rates.H_LEFT_TOKENS: "5"}, {}):
        s = parse(spark, bad)
        assert (s.tokens_remaining, s.headers_parsed) == (0, False)
    s = parse(spark, {rates.H_RESET_TOKENS: "soon", rates.H_LIMIT_TOKENS: "9"})
    assert (s.tokens_limit, s.headers_parsed, (s.reset_time - s.last_updated).total_seconds()) == (9, True, 60)
    assert not parse(spark, {rates.H_RESET_TOKENS: "soon"}).headers_parsed


def test_hot_key_order_operations(spark):
    """One key holds most rows; results equal a plain walk."""
    rows = [(0 if i % 10 else i, i, i % 7 + 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, v bigint").repartition(8)
    bucket = F.floor(F.col("t") / 100)
    got = lag_value(df, "k", ["t"], bucket, F.col("v"), "prev")
    got = running_sum(got, "k", ["t"], bucket, F.col("v"), "total").collect()
    seen, total = {}, {}
    want = {}
    for k, t, v in rows:
        total[k] = total.get(k, 0) + v
        want[t] = (seen.get(k), total[k])
        seen[k] = v
    assert {r.t: (r.prev, r.total) for r in got} == want


def test_token_counters(spark):
    df = spark.createDataFrame([("",), ("abcd",), (None,), ("boom",)], "s string")

    def factory():
        def encode(s):
            if s == "boom":
                raise ValueError
            return list(s)

        return encode

    got = [tuple(r) for r in df.select(TokenCounter().column("s"), ArrowTokenCounter("letters", factory).column("s")).collect()]
    assert got == [(1, 0), (2, 4), (None, None), (2, 2)]


def test_rows_without_key_or_time_stay(spark):
    rows = [(None, 1, 5), ("a", None, 7), ("a", 3, 1), ("a", None, 2), (None, None, 4), ("b", 9, 3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, t int, v int")
    bucket = F.floor(F.col("t") / 2)
    got = running_sum(lag_value(df, "k", ["t", "i"], bucket, F.col("v"), "prev"), "k", ["t", "i"], bucket, F.col("v"), "total")
    assert sorted((r.i, r.prev, r.total) for r in got.collect()) == [(0, 4, 9), (1, None, 7), (2, 2, 10), (3, 7, 9), (4, None, 4), (5, None, 3)]
