"""Chunkers and budgets under a user's tokenizer."""

import random
import re
import sys

import pytest
from models import normal
from pyspark import cloudpickle

from foliospark import ArrowTokenCounter, JobConfig, create_chunks, run_job
from foliospark.config import ChunkingError, ConfigError
from foliospark.functions.tokens import CharMeasure, Measure
from foliospark.operators.requests import replay_continuity
from foliospark.operators.responders import Identity, Responder

# Workers can't import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pairs():
    """Tokens of up to two characters that don't cross spaces."""
    return re.compile(r"\s|\S{1,2}").findall


PAIRS = ArrowTokenCounter("pairs", pairs, strict=True)
M = PAIRS.measure()


def longest_head(text, n):
    return max(i for i in range(len(text) + 1) if M.count(text[:i]) <= n)


def plain_split(text, n):
    out = []
    while text:
        i = max(1, longest_head(text, n))
        out.append((text[:i], M.count(text[:i])))
        text = text[i:]
    return out


def plain_chunks(text, cap):
    out, run, size = [], "", 0
    for line in normal(text).splitlines(keepends=True):
        k = M.count(line)
        if k > cap:
            out += [(run, size)] if run else []
            out += plain_split(line, cap)
            run, size = "", 0
        elif run and size + k > cap:
            out.append((run, size))
            run, size = line, k
        else:
            run, size = run + line, size + k
    return out + ([(run, size)] if run else [])


def words(rng, n):
    return "".join(rng.choice(["a", "bcd", " ", "\n", "längere", "🎉🎉"]) for _ in range(n))


def test_cuts_are_the_longest_that_fit():
    rng = random.Random(4)
    for _ in range(200):
        text, n = words(rng, rng.randint(0, 60)), rng.randint(1, 25)
        assert M.split(text, n) == plain_split(text, n)
        assert M.head(text, n) == longest_head(text, n)
        assert M.tail(text, n) == text[min(i for i in range(len(text) + 1) if M.count(text[i:]) <= n) :]
    assert M.tail("abc", 0) == "" and CharMeasure().tail("abcdefgh", 1) == "efgh"
    assert M.shortened("ab" * 64, 20, 5) == "ab" * 16 and M.shortened("ab" * 64, 20, 17) == ""


def test_long_lines_are_counted_in_parts():
    seen = []
    measure = Measure(lambda s: seen.append(len(s)) or len(s.split()))
    pieces = measure.split("word " * 40_000, 50)
    assert len(pieces) == 800 and all(k == 50 for _, k in pieces)
    assert max(seen) <= 8 * 4 * 50 and sum(seen) < 40 * 5 * 40_000


def test_text_chunks_by_counter(spark):
    rng = random.Random(2)
    docs = [(i, words(rng, rng.choice([0, 3, 80, 600]))) for i in range(40)] + [(99, "\r\n\r x\r\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = create_chunks(df, JobConfig(data_format="text", chunk_size=30, counter=PAIRS)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.text, r.token_count) for r in got] == [(i, t, k) for i, x in docs for t, k in plain_chunks(x, 30)]
    lines = JobConfig(data_format="markdown", splitter="lines", chunk_size=30, counter=PAIRS)
    assert create_chunks(df, lines).count() == len(got)


@pytest.mark.parametrize("data_format", ["semantic", "markdown", "xml", "paragraph"])
def test_character_chunkers_refuse_a_counter(spark, data_format):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ChunkingError):
        create_chunks(df, JobConfig(data_format=data_format, counter=PAIRS))


class Shown(Responder):
    """Answers with the whole request."""

    def __call__(self, messages, max_tokens, temp, top_p, chunk=None):
        return messages[-1]["content"], {}, "m"


def test_run_counts_and_cuts_context_by_the_counter(spark):
    config = JobConfig(data_format="text", chunk_size=10, sample_size=3, counter=PAIRS, prompt="ab cd")
    df = spark.createDataFrame([(1, "one two\nthree four\n")], "doc_id long, text string")
    first, second = run_job(spark, df, config, Shown()).responses.orderBy("chunk_index").collect()
    assert (first.response, first.total_input_tokens) == ("one two\n", config.prompt_tokens + M.count("one two\n"))
    assert second.response.startswith("\n---\n### Previous Input:\n" + M.tail("one two\n", 3) + "\n\n---")
    assert second.total_input_tokens == config.prompt_tokens + M.count(second.response) and second.response_tokens == M.count(second.response)
    with pytest.raises(ConfigError):
        replay_continuity(df, config)


def test_estimate_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "Python" not in create_chunks(df, JobConfig(data_format="text"))._jdf.queryExecution().toString()
    assert run_job(spark, df, JobConfig(data_format="text"), Identity()).documents.first().output_text == "x"
