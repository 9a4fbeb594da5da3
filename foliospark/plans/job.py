"""A whole run: documents in, documents and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import CHECKPOINT_MAX_AGE_HOURS, ConfigError, JobConfig
from ..functions.metadata import render_frontmatter, with_frontmatter
from ..operators.explain import complete_documents
from ..operators.reassemble import reassemble, with_empty_documents
from ..operators.registry import create_chunks
from ..operators.reports import (
    doc_state, dry_run_report, failures, run_summary, with_status, zero_output,
)
from ..operators.transform import LOG_FIELDS, answer_schema, diagnostics, run_name, transform_chunks, with_rates
from ..session import durable
from ..sources.answer_log import read_answers, whole_documents
from ..sources.documents import read_manifest, write_files
from ..sources.manifest import discover, folder_exists, list_files, prescreen, rooted
from ..sources.paths import load_ignore_lines, output_path


@dataclass
class JobResult:
    """Tables of one run; ``None`` for what a dry run does not produce."""

    chunks: DataFrame
    report: DataFrame
    responses: DataFrame | None = None
    documents: DataFrame | None = None
    quarantine: DataFrame | None = None
    diagnostics: DataFrame | None = None
    states: DataFrame | None = None
    failures: DataFrame | None = None
    summary: DataFrame | None = None
    unreadable: DataFrame | None = None
    written: DataFrame | None = None
    metrics: dict | None = None


def _empty_state(states: DataFrame, key: str, status: str) -> list:
    """Columns of a document state without any call."""
    zero = {"string": F.lit(None), "boolean": F.lit(False)}
    return [
        (F.lit(status) if f.name == "status" else zero.get(f.dataType.simpleString(), F.lit(0))).cast(f.dataType).alias(f.name)
        for f in states.schema
        if f.name != key
    ]


def _all_failures(chunk_rows: DataFrame, others: DataFrame | None, key: str) -> DataFrame:
    """Failed chunks, and (key, error) rows of documents that failed otherwise, without a chunk number."""
    if others is None:
        return chunk_rows
    return chunk_rows.unionByName(others.select(key, F.lit(None).cast(chunk_rows.schema["chunk_number"].dataType).alias("chunk_number"), "error"))


def _logged_answers(
    spark: SparkSession, docs: DataFrame, chunks: DataFrame, config: JobConfig, responder, fallbacks, key: str, log_dir: str, seen: Observation
) -> DataFrame:
    """Ask for what the log does not have yet, then take every answer from the log.

    Documents that an earlier run under the same settings answered wholly and without failures are not asked again, unless
    their text has changed or the answers are older than a day."""
    schema = spark.createDataFrame([], f"{answer_schema(chunks, key)}, {LOG_FIELDS}").schema
    named = docs.select(key, F.xxhash64("text").alias("doc_hash"))
    pair = [key, "doc_hash"]
    done = whole_documents(read_answers(spark, log_dir, schema), key, run_name(config), CHECKPOINT_MAX_AGE_HOURS).filter("failed = 0")
    todo = durable(named.join(done, pair, "left_anti"), "to-ask")
    asked = transform_chunks(chunks.join(todo, key), config, responder, fallbacks, key, log_dir=log_dir)
    # The answers are in the log by then: only what is counted is worked out for them here.
    counted = asked.select("error", "total_input_tokens", "response_tokens")
    _observed(counted, seen).write.format("noop").mode("overwrite").save()
    answers = read_answers(spark, log_dir, schema)
    chosen = whole_documents(answers, key, run_name(config)).join(named, pair, "left_semi").select(*pair, "attempt")
    once = answers.join(chosen, [*pair, "attempt"]).dropDuplicates([key, "chunk_index"])
    return durable(with_rates(once.select(*(f.name for f in schema if f.name not in ("doc_hash", "run", "attempt")))), "responses")


def _observed(answers: DataFrame, seen: Observation) -> DataFrame:
    return answers.observe(
        seen,
        F.count("*").alias("calls"),
        F.count_if(F.col("error").isNotNull()).alias("failed_calls"),
        F.sum("total_input_tokens").alias("input_tokens"),
        F.sum("response_tokens").alias("output_tokens"),
    )


def run_job(
    spark: SparkSession, docs: DataFrame, config: JobConfig, responder=None, fallbacks=(), key: str = "doc_id", log_dir: str | None = None
) -> JobResult:
    """Chunk, request, respond, reassemble and report.

    ``docs`` has ``key`` and ``text``.  Responses are written to the shared folder
    before anything reads them: a responder may answer differently when asked
    again, so a lost executor must not ask twice for rows already counted.

    With ``log_dir`` answers are logged while the run goes on, and a run that failed can be started again: only documents
    without a whole set of answers are asked for.  Keys must be unique then.
    """
    base = docs.select(key, "text")
    heads, lost_calls = None, None
    if config.explain:
        heads = with_frontmatter(base, config.quirks)
        if not config.dry_run and responder is not None:
            heads, lost_calls = complete_documents(heads, config, responder, key)
    chunks = create_chunks(base if heads is None else heads, config)

    report = dry_run_report(chunks, config.data_format, config.prompt_tokens)
    if config.dry_run or responder is None:
        return JobResult(chunks=chunks, report=report)

    seen = Observation()
    if log_dir:
        responses = _logged_answers(spark, base, chunks, config, responder, fallbacks, key, log_dir, seen)
    else:
        responses = durable(_observed(transform_chunks(chunks, config, responder, fallbacks, key), seen), "responses")
    states = with_status(doc_state(responses, key))
    nothing = base.select(key).join(states.select(key), key, "left_anti")
    states = states.unionByName(nothing.select(key, *_empty_state(states, key, "ok")))
    quarantine = zero_output(responses, key)
    assembled = with_empty_documents(base, reassemble(responses, key), key)
    documents = assembled.join(quarantine.select(key), key, "left_anti")
    if config.explain:
        # A header stays even if there is no text below it.
        text = F.when(
            F.coalesce(F.size("metadata"), F.lit(0)) > 0, render_frontmatter("metadata", F.col("output_text"))
        ).otherwise(F.col("output_text"))
        documents = documents.join(heads.select(key, "metadata"), key, "left").withColumn("output_text", text)
    documents = documents.join(states.select(key, F.col("status").alias("run_status")), key, "left").withColumn(
        "status", F.when(F.col("status") == "empty", F.col("status")).otherwise(F.coalesce("run_status", "status"))
    ).drop("run_status")
    return JobResult(
        chunks=chunks,
        report=report,
        responses=responses,
        documents=documents,
        quarantine=quarantine,
        diagnostics=diagnostics(responses, key),
        states=states,
        failures=_all_failures(failures(responses, key), lost_calls, key),
        summary=run_summary(states),
        metrics=seen.get,
    )


def run_folder(
    spark: SparkSession,
    input_dir: str,
    config: JobConfig,
    responder=None,
    output_dir: str | None = None,
    fallbacks=(),
    log_dir: str | None = None,
    waves: int = 1,
) -> JobResult:
    """Process the files of a folder; results go to ``output_dir`` or back in place.

    Files are listed and filtered by name before any content is read.  Contents are
    stored once in the shared folder, so writing in place cannot feed back into the
    run.

    With ``log_dir`` a failed run can be started again, see :func:`run_job`.  The files are then taken in ``waves`` by a
    hash of their paths; those of a wave are written before the next one is asked for.
    """
    if log_dir and not output_dir:
        raise ConfigError("a run in place changes its inputs and can't be started again: give output_dir with log_dir")
    input_dir, output_dir = rooted(input_dir), output_dir and rooted(output_dir)
    files = list_files(spark, input_dir)
    manifest = discover(
        files, config.recurse or "*", output_dir, load_ignore_lines(input_dir), config.unrestricted
    )
    if output_dir and not config.force and folder_exists(output_dir):
        manifest = prescreen(
            manifest, list_files(spark, output_dir).select("rel_path").withColumn(
                "path", output_path("rel_path", output_dir, "rel_path")
            )
        )
    manifest = durable(manifest, "manifest")
    stored = durable(read_manifest(manifest), "contents")
    docs = stored.filter(F.col("error").isNull()).select("path", "text")
    written = []
    if log_dir and responder is not None and not config.dry_run:
        log_dir = rooted(log_dir)
        for wave in range(waves - 1):
            part = docs.filter(F.pmod(F.xxhash64("path"), F.lit(waves)) == wave)
            done = run_job(spark, part, config, responder, fallbacks, "path", log_dir).documents
            written.append(durable(write_files(done.join(manifest.select("path", "output_path"), "path")), "written"))
    result = run_job(spark, docs, config, responder, fallbacks, "path", log_dir)
    result.unreadable = stored.filter(F.col("error").isNotNull()).select("path", "error")
    if result.states is not None:
        lost = result.unreadable.select("path", *_empty_state(result.states, "path", "failed"))
        result.states = result.states.unionByName(lost)
        result.summary = run_summary(result.states)
        result.failures = _all_failures(result.failures, result.unreadable, "path")
    if result.documents is not None:
        outputs = result.documents.join(manifest.select("path", "output_path"), "path")
        for part in written:
            outputs = outputs.join(part.filter("error IS NULL"), "output_path", "left_anti")
        result.written = durable(write_files(outputs), "written")
        for part in written:
            result.written = result.written.unionByName(part.filter("error IS NULL"))
    return result
