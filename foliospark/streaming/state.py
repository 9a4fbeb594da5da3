"""Per-document state across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import CHECKPOINT_MAX_AGE_HOURS
from ..functions.tokens import CHARS_PER_TOKEN

TOTALS = "chunks bigint, tokens bigint, last_index int"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Typed state lives in RocksDB, on disk and not on the heap.  A stream that has a checkpoint keeps the store it has."""
    spark.conf.set(_STORE, _ROCKSDB)


class _Documents(StatefulProcessor):
    """Totals and the latest texts of a document: state values of their own, since they change at different times and expire
    by themselves."""

    def __init__(self, keys: list[str], tail: int, ttl_ms: int | None, output: str | None):
        self.keys, self.tail, self.ttl, self.output = keys, tail, ttl_ms, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", TOTALS, self.ttl)
        self.last_input = handle.getValueState("last_input", "text string", self.ttl)
        if self.output:
            self.out_tokens = handle.getValueState("output_tokens", "tokens bigint", self.ttl)
            self.last_output = handle.getValueState("last_output", "text string", self.ttl)

    def _tail(self, text) -> str:
        return text[-self.tail :] if self.tail and isinstance(text, str) else ""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, tokens, last = self.totals.get() or (0, 0, -1)
        out_tokens = (self.out_tokens.get() or (0,))[0] if self.output else 0
        newest = None
        for b in rows:
            n += len(b)
            tokens += int(b["token_count"].sum())
            if self.output:
                out_tokens += int((b["output"].str.len() // CHARS_PER_TOKEN + 1).sum())
            top = b.loc[b["chunk_index"].idxmax()]
            if int(top["chunk_index"]) > last:
                last, newest = int(top["chunk_index"]), top
        self.totals.update((n, tokens, last))
        if newest is not None:
            self.last_input.update((self._tail(newest["text"]),))
        elif self.ttl:
            self.last_input.update(self.last_input.get() or ("",))  # a document with news does not expire in part
        made = {"chunks": n, "tokens": tokens, "last_index": last, "last_text": (self.last_input.get() or ("",))[0]}
        if self.output:
            self.out_tokens.update((out_tokens,))
            if newest is not None:
                self.last_output.update((self._tail(newest["output"]),))
            elif self.ttl:
                self.last_output.update(self.last_output.get() or ("",))
            made |= {"output_tokens": out_tokens, "last_output": (self.last_output.get() or ("",))[0]}
        yield pd.DataFrame({c: [v] for c, v in [*zip(self.keys, key), *made.items()]})

    def close(self) -> None:
        pass


def track_documents(
    chunks: DataFrame,
    sample_size: int,
    max_age_hours: float | None = CHECKPOINT_MAX_AGE_HOURS,
    key: str | list[str] = "doc_id",
    output: str | None = None,
) -> DataFrame:
    """Totals and the tail of the latest chunk of each document, updated per batch.

    ``chunks`` has the columns of ``key`` (one or several, of any type), ``chunk_index``, ``token_count`` and ``text``.  With
    ``output``, the column of the answers, rows without an answer are passed over, and the tokens of all answers and the tail
    of the latest one are kept too, which is what the next chunk's request needs.

    Arrow batches of a group are folded one after another, so a group of any size needs the memory of one batch.  A value
    expires ``max_age_hours`` after its document's last news: it reads as missing from then on, and the store drops it when it
    compacts.  Pass ``None`` for a run that ends when its input does: with a clock in play Spark goes on with empty batches.
    """
    use_rocksdb(chunks.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    ttl = int(max_age_hours * 3_600_000) if max_age_hours else None
    columns = [*keys, "chunk_index", "token_count", "text"]
    if output:
        chunks = chunks.filter(chunks[output].isNotNull()).withColumn("output", chunks[output])
        columns.append("output")
    kinds = [f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, TOTALS, "last_text string", *(["output_tokens bigint, last_output string"] if output else [])])
    processor = _Documents(keys, CHARS_PER_TOKEN * sample_size, ttl, output)
    mode = "ProcessingTime" if ttl else "None"
    return chunks.select(*columns).groupBy(*keys).transformWithStateInPandas(processor, schema, "append", mode)
