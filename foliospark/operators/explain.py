"""Complete missing metadata from the first chunk of a document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import JobConfig
from ..functions.metadata import (
    EXPLAIN_SYSTEM, explain_prompt, is_complete, merge_metadata, parse_generated,
)
from ..session import durable
from .registry import create_chunks
from .responders import chain_of, respond

#: Further attempts of a failed metadata call.
METADATA_RETRIES = 8


def ask_metadata(prompts: DataFrame, config: JobConfig, responder, key: str = "doc_id") -> DataFrame:
    """One metadata call per row of (key, prompt), retried like any call: key, generated, error."""
    cfg = config
    chain = chain_of(responder, config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for this, prompt in batch.itertuples(index=False, name=None):
                msgs = [
                    {"role": "system", "content": EXPLAIN_SYSTEM},
                    {"role": "user", "content": prompt},
                ]
                answer, error = None, None
                try:
                    answer = respond(chain, msgs, None, cfg.temp, cfg.top_p, None, METADATA_RETRIES)[0]
                except Exception as e:
                    error = str(e)
                rows.append((this, answer, error))
            yield pd.DataFrame(rows, columns=[key, "generated", "error"])

    kind = prompts.schema[key].dataType.simpleString()
    tasks = config.workers or prompts.sparkSession.sparkContext.defaultParallelism
    return prompts.select(key, "prompt").repartition(tasks, key).mapInPandas(run, f"{key} {kind}, generated string, error string")


def complete_documents(
    parsed: DataFrame, config: JobConfig, responder, key: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """``parsed`` (key, metadata, text) with missing fields completed, and the failed calls (key, error).

    Headers are parsed once and stored.  Only documents with missing fields are cut into chunks here, for the first
    chunk that the request shows.  Answers are written before they are joined, so they are asked for once.
    """
    stored = durable(parsed, "parsed")
    first = create_chunks(stored.filter(~is_complete("metadata")), config).filter(F.col("chunk_index") == 0)
    prompts = first.select(key, explain_prompt("metadata", "text", config.explain_chars).alias("prompt"))
    answers = durable(ask_metadata(prompts, config, responder, key), "metadata")
    generated = answers.select(F.col(key).alias("_key"), parse_generated("generated").alias("extra"))
    merged = merge_metadata("metadata", F.coalesce("extra", F.create_map().cast("map<string,string>")))
    done = stored.join(generated, F.col(key) == F.col("_key"), "left").withColumn("metadata", merged).drop("extra", "_key")
    return durable(done, "completed"), answers.filter("error is not null").select(key, "error")


def complete_metadata(parsed: DataFrame, config: JobConfig, responder, key: str = "doc_id") -> DataFrame:
    """Chunks whose ``metadata`` column is completed where fields were missing."""
    return create_chunks(complete_documents(parsed, config, responder, key)[0], config)
