"""Run a responder over requests, in document order.

Documents are independent; the chunks of one document are sequential, because a
chunk is sent with the tail of the previous answer.  Requests are hashed by
document, sorted inside partitions, and streamed through Python in Arrow batches
with only the previous chunk kept as state, so memory does not grow with a
document.  With ``sample_size=0`` chunks are independent and nothing is shuffled.
With a log folder, answers are on disk before the run ends, and a later run takes them from there.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MAX_CONTEXT_TOKENS, JobConfig
from ..functions.budget import CONTINUITY_HEAD, CONTINUITY_MIDDLE, CONTINUITY_TAIL, MIN_USEFUL_TOKENS, shortened_length
from ..functions.rates import parse_rate_headers
from ..functions.tokens import CharMeasure, Measure, exact
from ..sources.answer_log import AnswerWriter
from ..sources.manifest import rooted
from .pacer import Pacer
from .requests import prepare_requests
from .responders import chain_of, respond

RESPONSE_FIELDS = (
    "chunk_index int, n_chunks int, chunk_tokens int, total_input_tokens int, max_completion_tokens int, "
    "response string, response_tokens int, response_chars int, model string, "
    "temperature double, top_p double, headers string, answered_at timestamp, error string, seconds double"
)


LOG_FIELDS = "doc_hash long, run string, attempt string"


def run_name(config: JobConfig) -> str:
    """Which settings an answer was given under; logged answers of others don't count."""
    same = {k: v for k, v in vars(config).items() if k not in ("workers", "counter", "pacing", "force", "dry_run")}
    same["counter"] = getattr(config.counter, "name", None)
    return hashlib.sha256(json.dumps(same, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _continuity(prev, size: int, base: int, measure: Measure) -> str:
    """The context block that may stand beside ``base`` tokens; see ``shortened_length`` for what is cut."""
    if prev is None or size <= 0 or not all(part := [measure.tail(x, size) for x in prev]):
        return ""
    block = CONTINUITY_HEAD + part[0] + CONTINUITY_MIDDLE + part[1] + CONTINUITY_TAIL
    if isinstance(measure, CharMeasure):
        return block[: shortened_length(len(block), MAX_CONTEXT_TOKENS - base)]
    return measure.shortened(block, MAX_CONTEXT_TOKENS - base, MIN_USEFUL_TOKENS)


def transform_chunks(
    chunks: DataFrame, config: JobConfig, responder, fallbacks=(), key: str = "doc_id",
    log_dir: str | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """chunk table to response table: one row per chunk, errors as values.

    With ``log_dir``, each task also writes its answers there while it runs; ``chunks`` then has ``doc_hash``, the hash of
    the whole document.  With ``config.pacing="headers"``, a task waits as the headers of its last answer ask."""
    return with_rates(_answers(chunks, config, responder, fallbacks, key, log_dir, clock, sleep))


def answer_schema(chunks: DataFrame, key: str) -> str:
    return f"{key} {chunks.schema[key].dataType.simpleString()}, {RESPONSE_FIELDS}"


def _answers(chunks, config, responder, fallbacks, key, log_dir, clock, sleep) -> DataFrame:
    chain = chain_of(responder, config, fallbacks)
    columns = [key, "chunk_index", "n_chunks", "text", "token_count", "metadata_context", "max_completion_tokens"]
    columns += ["doc_hash"] if log_dir else []
    ready = prepare_requests(chunks, config).select(*columns)
    if config.sample_size > 0:
        # Calls take seconds, whatever their bytes: the number of tasks is given, so that it is not merged by size.
        tasks = config.workers or chunks.sparkSession.sparkContext.defaultParallelism
        ready = ready.repartition(tasks, key).sortWithinPartitions(key, "chunk_index")
    elif config.workers:
        # Fewer partitions bound the number of calls in flight.
        ready = ready.repartition(config.workers)
    cfg, counter = config, exact(config.counter)
    tasks = config.workers or chunks.sparkSession.sparkContext.defaultParallelism
    schema = answer_schema(chunks, key)
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    nullable = ["response_tokens", "response_chars"]
    if log_dir:
        folder, run_id = rooted(log_dir), run_name(config)
        # The types that Spark gives the answers, so that all files of the log agree.
        logged = chunks.sparkSession.createDataFrame([], f"{schema}, {LOG_FIELDS}").toArrow().schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measure = counter.measure() if counter else CharMeasure()
        pacer = Pacer(tasks, clock, sleep) if cfg.pacing == "headers" else None
        writer = AnswerWriter(folder, logged) if log_dir else None
        doc, prev = object(), None

        def table(rows: list[tuple], hashes: list[int]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            for c in nullable:
                out[c] = out[c].astype("Int64")
            if writer and rows:
                writer.write(out.assign(doc_hash=hashes, run=run_id))
            return out

        for batch in batches:
            rows, hashes = [], []
            for r in batch.itertuples(index=False, name=None):
                this, idx, n, text, tokens, context, budget, *more = r
                if this != doc:
                    doc, prev = this, None
                started = time.monotonic()
                answer, shown, model, error = None, None, None, None
                user = context + _continuity(prev, cfg.sample_size, base_tokens + tokens, measure) + text
                total = base_tokens + measure.count(user)
                try:
                    if total > MAX_CONTEXT_TOKENS:
                        raise ValueError(
                            f"Input too large: {total} tokens > {MAX_CONTEXT_TOKENS} limit"
                        )
                    msgs = [
                        {"role": "system", "content": cfg.prompt},
                        {"role": "user", "content": user},
                    ]
                    if pacer:
                        pacer.before(total)
                    answer, headers, model = respond(
                        chain, msgs, budget, cfg.temp, cfg.top_p, text, cfg.max_retry_attempts
                    )
                    if pacer:
                        pacer.answered(headers)
                    shown = json.dumps({str(k): None if v is None else str(v) for k, v in dict(headers).items()})
                    prev = (text, answer)
                except Exception as e:
                    error = str(e)
                rows.append(
                    (
                        this, idx, n, tokens, total, budget, answer,
                        None if answer is None else measure.count(answer),
                        None if answer is None else len(answer),
                        model, cfg.temp, cfg.top_p, shown, pd.Timestamp.now("UTC"), error,
                        time.monotonic() - started,
                    )
                )
                hashes += more
                if writer and writer.is_due(len(rows)):
                    yield table(rows, hashes)
                    rows, hashes = [], []
            yield table(rows, hashes)

    base_tokens = config.prompt_tokens
    return ready.mapInPandas(run, schema)


def with_rates(answers: DataFrame) -> DataFrame:
    """What the headers of an answer say about the limits; null where they say nothing."""
    headers = F.from_json("headers", "map<string,string>")
    status = answers.withColumn("_s", parse_rate_headers(F.coalesce(headers, F.create_map().cast("map<string,string>")), "answered_at"))
    known = F.col("_s.headers_parsed")
    return status.withColumns(
        {
            "rate_requests_remaining": F.when(known, F.col("_s.requests_remaining")),
            "rate_tokens_remaining": F.when(known, F.col("_s.tokens_remaining")),
            "rate_headers_parsed": known,
        }
    ).drop("_s", "headers", "answered_at")


def diagnostics(responses: DataFrame, key: str = "doc_id") -> DataFrame:
    """The per-chunk record of successful calls, chunk numbers from 1."""
    return responses.filter(F.col("error").isNull()).select(
        key,
        (F.col("chunk_index") + 1).alias("chunk_index"),
        "chunk_tokens", "total_input_tokens", "max_completion_tokens", "response_tokens",
        "response_chars", "model", "temperature", "top_p", "rate_requests_remaining",
        "rate_tokens_remaining", "rate_headers_parsed",
    )


def pick_fallback(attempts: DataFrame, chain: DataFrame) -> DataFrame:
    """Which model answered a request: the first of the chain that succeeded.

    ``attempts``: doc_id, chunk_index, model, response, error.  ``chain``: model,
    ord, max_output_tokens.  One aggregation with map-side combine, no sort.
    """
    ranked = attempts.join(chain, "model")
    ok = F.col("error").isNull() & (F.length("response") > 0)
    best = F.min_by(F.struct("model", "response", "ord"), F.when(ok, F.col("ord")))
    return (
        ranked.groupBy("doc_id", "chunk_index")
        .agg(best.alias("b"), F.count("*").alias("n_attempts"))
        .select(
            "doc_id", "chunk_index", F.col("b.model").alias("model"),
            F.col("b.response").alias("response"), "n_attempts",
        )
    )
