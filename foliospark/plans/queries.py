"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..config import JobConfig
from ..functions import budget, metadata, rates, text as tx
from ..functions.sql import register_functions
from ..functions.tokens import token_count
from ..functions.xml import xml_normalize, xml_spans
from ..operators import chunk_code, chunk_structure, chunk_text, chunk_xml, pack_lines, pacing, reports, text_repair
from ..operators import requests as rq
from ..operators.explain import complete_metadata
from ..operators.pack import greedy_cuts
from ..operators.reassemble import chunk_output, reassemble, with_empty_documents
from ..operators.responders import Constant, Identity, Scripted, Upper
from ..operators.transform import diagnostics, pick_fallback, transform_chunks
from ..session import durable, fresh_path
from ..sources import documents as store
from ..sources import manifest, paths
from ..sources.answer_log import run_progress
from ..streaming.ingest import drain, read_stream, start_deduplicated, stream_chunks
from ..streaming.quota import stream_quota
from ..streaming.state import track_documents
from . import inputs
from .inputs import CS, SAMPLE
from .job import run_folder, run_job

QUERIES = {}
TEXT = JobConfig(data_format="text", chunk_size=CS, sample_size=SAMPLE)
IGNORE_LINES = ["# build output", "*.log", "!7*.log", "build/", "/src1/en"]
GENERATED = {"title": "GT", "author": "GA", "id": "GI", "type": "GY", "date": "GD"}


def query(fn):
    """Register under the function's name, less a ``_query`` suffix."""
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def micros(c):
    return F.unix_micros(c)


# --- sources and sinks ---


@query
def discover(spark, sf):
    found = manifest.discover(inputs.written_files(spark, sf), "*.{md,txt}", "/out")
    return found.select("rel_path", "length", "output_path")


@query
def file_info(spark, sf):
    return inputs.written_files(spark, sf).select("rel_path", "length", F.col("modified").isNotNull().alias("has_time"))


@query
def match_patterns(spark, sf):
    p = inputs.paths(spark, sf)
    hit = lambda *globs: paths.matches_any("rel_path", [e for g in globs for e in paths.expand_braces(g)])
    return p.select(
        "rel_path", hit("*.{md,txt}").alias("flat"), hit("src1*/**/*.md").alias("deep"),
        hit("[ac]/?.log").alias("classes"), paths.below_git("rel_path").alias("in_git"),
    )


@query
def expand_patterns(spark, sf):
    p = inputs.paths(spark, sf).select("doc_id", F.concat(F.col("rel_path"), F.lit("/*.{md, ,py}")).alias("pattern"))
    return p.select("doc_id", F.explode(manifest.expand_pattern("pattern")).alias("expanded"))


@query
def pattern_union(spark, sf):
    return manifest.discover(inputs.paths(spark, sf), "{*.md,src1/**/*}").select("rel_path")


@query
def ignore_filter(spark, sf):
    p = inputs.paths(spark, sf)
    return p.filter(~paths.is_ignored("rel_path", IGNORE_LINES)).select("rel_path")


@query
def map_paths(spark, sf):
    return inputs.paths(spark, sf).select(
        "path", paths.output_path("rel_path", "/out/", "path").alias("mirrored"),
        paths.output_path("rel_path", None, "path").alias("in_place"),
    )


def _pairs(spark, sf):
    p = inputs.paths(spark, sf)
    out = F.when(F.col("doc_id") % 5 == 0, F.col("path")).otherwise(F.concat(F.lit("/out/"), "rel_path"))
    return p.withColumn("output_path", out)


@query
def prescreen(spark, sf):
    pairs = _pairs(spark, sf)
    existing = pairs.filter(F.col("doc_id") % 2 == 0).select(F.col("output_path").alias("path"))
    return manifest.prescreen(pairs, existing).select("path", "output_path")


@query
def resume_pending(spark, sf):
    d = inputs.documents(spark, sf).select("doc_id")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    hours = F.make_dt_interval(hours=(F.col("doc_id") % 48).cast("int"))
    done = d.filter(F.col("doc_id") % 2 == 0).withColumn("completed_at", now - hours)
    return manifest.pending(d, done, now)


@query
def read_docs(spark, sf):
    raw = inputs.documents(spark, sf).select(
        "doc_id", F.length(F.encode("text", "UTF-8")).alias("length"),
        F.when(F.col("doc_id") % 50 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FFFE"))))
        .otherwise(F.encode("text", "UTF-8")).alias("content"),
    )
    return store.decode_documents(raw).select("doc_id", "text", "error")


@query
def size_guard(spark, sf):
    return manifest.size_guard(inputs.paths(spark, sf), 2_000).select("doc_id", "length", "error")


@query
def write_docs(spark, sf):
    path = fresh_path(spark, "documents")
    store.write_table(inputs.documents(spark, sf), path)
    return spark.read.parquet(path)


@query
def write_doc_files(spark, sf):
    base = fresh_path(spark, "files")
    docs = inputs.documents(spark, sf).select(
        F.concat(F.lit(f"{base}/"), (F.col("doc_id") % 16).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("output_path"),
        F.col("text").alias("output_text"),
    )
    done = durable(store.write_files(docs), "written")
    return done.select(
        F.regexp_extract("output_path", r"(\d+)\.txt$", 1).cast("bigint").alias("doc_id"), "bytes", "error"
    )


@query
def empty_docs(spark, sf):
    d = inputs.documents(spark, sf).withColumn("text", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text")))
    c = chunk_text.chunk_text(d, CS).select("doc_id", "chunk_index", "n_chunks", F.col("text").alias("response"), F.lit(None).cast("string").alias("error"))
    return with_empty_documents(d, reassemble(c)).select("doc_id", "output_text", "status")


# --- chunkers ---


@query
def greedy_pack(spark, sf):
    d = inputs.documents(spark, sf).withColumn("k", F.transform(tx.split_lines("text"), token_count)).drop("text")
    d = d.withColumn("cuts", greedy_cuts(F.col("k"), CS)).drop("k")
    rows = d.select("doc_id", F.posexplode_outer("cuts")).filter(F.col("pos").isNotNull())
    return rows.select("doc_id", F.col("pos").alias("group_index"), F.col("col.st").alias("first_line"), F.col("col.n").alias("n_lines"), F.col("col.tk").alias("token_count"), F.col("col.solo").alias("solo"))


CHUNK = ("doc_id", "chunk_index", "text", "token_count")


@query
def chunk_text_query(spark, sf):
    return inputs.chunks(spark, sf).select(*CHUNK)


@query
def split_overlong(spark, sf):
    return chunk_text.split_overlong(inputs.documents(spark, sf), CS).select(*CHUNK)


@query
def chunk_paragraph(spark, sf):
    d = inputs.markdown_documents(spark, sf)
    return chunk_text.chunk_paragraph(d, CS).select(*CHUNK)


@query
def chunk_code_query(spark, sf):
    return chunk_code.chunk_code(inputs.code_documents(spark, sf), CS).select(*CHUNK)


@query
def chunk_code_reference_tally(spark, sf):
    return chunk_code.chunk_code(inputs.code_documents(spark, sf), 20, "reference").select(*CHUNK)


@query
def chunk_lines_query(spark, sf):
    """Documents as lines, in blocks far smaller than in production, so that most documents span several."""
    lines = pack_lines.document_lines(inputs.documents(spark, sf))
    return pack_lines.chunk_lines(lines, CS, block_lines=16).select(*CHUNK)


# --- chunks by a tokenizer's counts ---


@query
def chunk_text_words(spark, sf):
    return chunk_text.chunk_text(inputs.documents(spark, sf), inputs.WORDS_CS, inputs.WORDS).select(*CHUNK)


@query
def chunk_code_words(spark, sf):
    return chunk_code.chunk_code(inputs.code_documents(spark, sf), inputs.WORDS_CS, counter=inputs.WORDS).select(*CHUNK)


@query
def split_overlong_words(spark, sf):
    return chunk_text.split_overlong(inputs.documents(spark, sf), inputs.WORDS_CS, inputs.WORDS).select(*CHUNK)


@query
def tail_sample_words(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", inputs.WORDS.tail_column("text", SAMPLE).alias("tail"))


@query
def code_line_features(spark, sf):
    return chunk_code.code_line_table(inputs.code_documents(spark, sf))


@query
def code_depth(spark, sf):
    return chunk_code.code_depth(inputs.code_documents(spark, sf))


@query
def chunk_semantic(spark, sf):
    return chunk_structure.chunk_semantic(inputs.documents(spark, sf), CS, "lines").select(*CHUNK)


@query
def chunk_markdown(spark, sf):
    return chunk_structure.chunk_markdown(inputs.markdown_documents(spark, sf), CS, "lines").select(*CHUNK)


@query
def chunk_semantic_structure(spark, sf):
    return chunk_structure.chunk_semantic(inputs.documents(spark, sf), CS).select(*CHUNK)


@query
def chunk_markdown_structure(spark, sf):
    return chunk_structure.chunk_markdown(inputs.markdown_documents(spark, sf), CS).select(*CHUNK)


@query
def md_sections(spark, sf):
    return chunk_structure.markdown_sections(inputs.markdown_documents(spark, sf))


@query
def chunk_xml_query(spark, sf):
    return chunk_xml.chunk_xml(inputs.pages(spark, sf), CS).select(*CHUNK)


@query
def xml_normalize_query(spark, sf):
    return inputs.pages(spark, sf).select("doc_id", xml_normalize("text").alias("xml"))


@query
def xml_normalize_text(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", xml_normalize("text").alias("xml"))


@query
def xml_spans_query(spark, sf):
    d = inputs.wrapped_lines(spark, sf).select("doc_id", F.array_join("elements", "").alias("text"))
    return d.select("doc_id", F.explode(xml_spans("text")).alias("s")).select("doc_id", "s.start", "s.end")


@query
def xml_pack(spark, sf):
    return chunk_xml.pack_elements(inputs.wrapped_lines(spark, sf), CS).select(*CHUNK)


@query
def chunk_xml_children(spark, sf):
    whole = F.concat(F.lit("<doc>"), F.array_join("elements", ""), F.lit("</doc>"))
    d = inputs.wrapped_lines(spark, sf).select("doc_id", whole.alias("text"))
    return chunk_xml.chunk_xml_children(d, CS).select(*CHUNK)


# --- text and budget expressions ---


@query
def norm_newlines(spark, sf):
    return inputs.crlf_documents(spark, sf).select("doc_id", tx.norm_newlines("text").alias("text"))


@query
def token_count_query(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", token_count("text").alias("tokens"))


@query
def split_lines(spark, sf):
    d = inputs.documents(spark, sf).select("doc_id", tx.split_lines("text").alias("lines"))
    rows = d.select("doc_id", F.posexplode_outer("lines").alias("line_no", "line"))
    return rows.filter(F.col("line_no").isNotNull())


@query
def blank_chunks(spark, sf):
    c = chunk_text.chunk_text(inputs.markdown_documents(spark, sf), 2)
    return c.groupBy("doc_id").agg(F.count_if(tx.is_blank("text")).alias("n_blank"), F.count("*").alias("n"))


@query
def tail_sample(spark, sf):
    return inputs.chunks(spark, sf).select("doc_id", "chunk_index", budget.tail_sample("text", SAMPLE).alias("tail"))


@query
def continuity_block(spark, sf):
    c = inputs.chunks(spark, sf)
    tail = budget.tail_sample("text", SAMPLE)
    return c.select("doc_id", "chunk_index", budget.continuity_block(tail, F.when(F.col("chunk_index") % 2 == 0, tail).otherwise("")).alias("block"))


@query
def fit_budget(spark, sf):
    base = (F.lit(131000) - F.col("doc_id") * 37 % 2000).cast("int")
    return inputs.documents(spark, sf).select("doc_id", budget.fit_to_budget("text", base).alias("fitted"))


@query
def continuity_budget(spark, sf):
    c = inputs.documents(spark, sf).select("doc_id", token_count("text").alias("k"))
    return c.select("doc_id", budget.continuity_budget("k", F.lit(129_500), 200).alias("budget"))


@query
def completion_budget(spark, sf):
    c = inputs.documents(spark, sf).select("doc_id", token_count("text").alias("k"))
    ratio = (F.col("doc_id") % 900 + 1).cast("int")
    return c.select("doc_id", budget.completion_budget("k", ratio).alias("budget"))


@query
def model_budget(spark, sf):
    d = inputs.documents(spark, sf).select("doc_id", budget.completion_budget(token_count("text"), 100).alias("b"))
    limit = F.when(F.col("doc_id") % 2 == 0, 2048).otherwise(40960)
    return d.select("doc_id", budget.model_budget("b", limit).alias("budget"))


@query
def chunk_preview(spark, sf):
    c = chunk_text.chunk_text(inputs.markdown_documents(spark, sf), CS)
    return c.select("doc_id", "chunk_index", tx.preview("text").alias("preview"))


# --- metadata ---


def _parsed(spark, sf):
    return metadata.with_frontmatter(inputs.front_documents(spark, sf))


@query
def frontmatter_parse(spark, sf):
    return _parsed(spark, sf).select("doc_id", metadata.metadata_json("metadata").alias("metadata"), F.col("text").alias("body"))


@query
def frontmatter_render(spark, sf):
    return _parsed(spark, sf).select("doc_id", metadata.render_frontmatter("metadata", "text").alias("text"))


@query
def metadata_complete(spark, sf):
    return _parsed(spark, sf).select("doc_id", metadata.is_complete("metadata").alias("complete"), F.array_join(metadata.missing_fields("metadata"), ",").alias("missing"))


@query
def metadata_missing_rows(spark, sf):
    return _parsed(spark, sf).select("doc_id", F.explode(metadata.missing_fields("metadata")).alias("field"))


@query
def metadata_context(spark, sf):
    return _parsed(spark, sf).select("doc_id", metadata.metadata_context("metadata").alias("context"))


@query
def metadata_merge(spark, sf):
    p = _parsed(spark, sf)
    new = F.create_map(F.lit("author"), F.concat(F.lit('"A'), F.col("doc_id").cast("string"), F.lit('"')), F.lit("date"), F.lit('"today"'))
    return p.select("doc_id", metadata.metadata_json(metadata.merge_metadata("metadata", new)).alias("metadata"))


@query
def explain_prompt(spark, sf):
    p = _parsed(spark, sf)
    first = chunk_text.chunk_text(p, 2_000).filter(F.col("chunk_index") == 0)
    return first.select("doc_id", metadata.explain_prompt("metadata", "text").alias("prompt"))


@query
def explain_flow(spark, sf):
    p = _parsed(spark, sf)
    done = complete_metadata(p, TEXT, Constant(json.dumps(GENERATED)))
    return done.filter(F.col("chunk_index") == 0).select("doc_id", metadata.metadata_json("metadata").alias("metadata"))


# --- requests and responses ---


@query
def build_requests(spark, sf):
    cfg = JobConfig(data_format="text", chunk_size=CS, prompt="Fix." * 130_900)
    c = inputs.chunks(spark, sf, "source").withColumn("metadata", F.create_map(F.lit("source"), metadata.json_string(F.col("source"))))
    r = rq.build_requests(rq.prepare_requests(c, cfg), cfg)
    user = F.when(F.col("error").isNull(), F.col("user_content"))
    return r.select("doc_id", "chunk_index", "total_input_tokens", "max_completion_tokens", user.alias("user_content"), "error")


@query
def continuity_replay(spark, sf):
    r = inputs.responses(spark, sf)
    return rq.replay_continuity(r, TEXT).select("doc_id", "chunk_index", "continuity")


@query
def attach_responses(spark, sf):
    r = inputs.responses(spark, sf)
    c = inputs.chunks(spark, sf)
    return rq.attach_responses(c, r.filter(F.col("chunk_index") % 4 != 3)).select("doc_id", "chunk_index", "text", "response", "error")


@query
def transform_identity(spark, sf):
    answers = durable(transform_chunks(inputs.chunks(spark, sf), TEXT, Identity()), "responses")
    return reassemble(answers).select("doc_id", "output_text")


@query
def transform_upper(spark, sf):
    r = transform_chunks(inputs.chunks(spark, sf), JobConfig(chunk_size=CS, sample_size=0), Upper())
    return r.select("doc_id", "chunk_index", "response")


@query
def chunk_diagnostics(spark, sf):
    r = diagnostics(transform_chunks(inputs.chunks(spark, sf), TEXT, Identity()))
    return r.select("doc_id", "chunk_index", "chunk_tokens", "total_input_tokens", "max_completion_tokens", "response_tokens", "response_chars", "model", "temperature", "rate_headers_parsed")


@query
def fallback_pick(spark, sf):
    c = inputs.chunks(spark, sf).select("doc_id", "chunk_index", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    bad = (F.col("doc_id") + F.col("chunk_index") + F.col("j") * 5) % 4 < 2
    attempts = c.select(
        "doc_id", "chunk_index", F.concat(F.lit("m"), F.col("j").cast("string")).alias("model"),
        F.concat(F.lit("r"), F.col("j").cast("string")).alias("response"), F.when(bad, "429").alias("error"),
    )
    chain = spark.range(3).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model"), F.col("id").cast("int").alias("ord"))
    return pick_fallback(attempts, chain)


@query
def error_placeholder(spark, sf):
    r = inputs.responses(spark, sf)
    return r.select("doc_id", "chunk_index", chunk_output(F.col("chunk_index"), F.col("response"), F.col("error")).alias("output"))


@query
def reassemble_query(spark, sf):
    return reassemble(durable(inputs.responses(spark, sf), "responses"))


@query
def conversation_requests(spark, sf):
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    r = rq.conversation_requests(t)
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return r.select("conv_id", "n_messages", "total_tokens", "over_limit", "error", flat.alias("transcript"))


# --- rates ---


@query
def parse_rate_headers(spark, sf):
    s = inputs.rate_log(spark, sf).select("request_id", "status.*")
    return s.select(
        "request_id", "requests_remaining", "tokens_remaining", "tokens_limit", "requests_limit", "headers_parsed",
        micros("reset_time").alias("reset_us"), micros("requests_reset_time").alias("requests_reset_us"),
    )


@query
def backoff_delay(spark, sf):
    log = inputs.rate_log(spark, sf)
    now = F.timestamp_micros(F.unix_micros("ts") + F.col("request_id") % 3 * 400_000)
    return log.select("request_id", F.round(rates.backoff_delay("status", F.col("tokens") * 20, now), 6).alias("delay"))


@query
def rate_exhausted(spark, sf):
    log = inputs.rate_log(spark, sf)
    now = F.timestamp_micros(F.unix_micros("ts") + 20_000_000)
    return log.select(
        "request_id", rates.tokens_exhausted("status", F.col("tokens") * 20).alias("tokens_exhausted"),
        rates.requests_exhausted("status").alias("requests_exhausted"),
        rates.seconds_to_reset(F.col("status.reset_time"), now).alias("seconds_left"),
    )


ERROR_TEXTS = ("Rate limit reached", "HTTP 429", "token_quota_exceeded", "Internal Error, please try again", "bad request", "error code: 500")


@query
def classify_errors(spark, sf):
    e = inputs.request_log(spark, sf)
    text = F.element_at(F.array(*[F.lit(x) for x in ERROR_TEXTS]), (F.col("request_id") % 6 + 1).cast("int"))
    code = F.element_at(F.array(*[F.lit(x) for x in (200, 400, 429, 502, 500)]), (F.col("request_id") % 5 + 1).cast("int"))
    return e.select("request_id", rates.classify_error(text, code).alias("c"), rates.retryable_status(code, True).alias("retry_metadata")).select("request_id", "c.*", "retry_metadata")


@query
def quota_usage(spark, sf):
    used = rates.usage_percent(F.col("status.requests_limit"), F.col("status.requests_remaining"))
    log = inputs.rate_log(spark, sf).select("request_id", F.round(used, 6).alias("used_percent"))
    return log.withColumn("warn", F.col("used_percent") > 80)


@query
def pacing_replay(spark, sf):
    r = pacing.replay_pacing(inputs.rate_log(spark, sf))
    return r.select("request_id", F.round("delay", 6).alias("delay"))


@query
def pacing_plan(spark, sf):
    return pacing.pacing_plan(inputs.request_log(spark, sf), 5_000, 3).select("client", "request_id", "tokens_so_far", "requests_so_far", "dispatch_minute")


LIMITS = (9_000, 3)  # tokens and requests a minute


@query
def dispatch_plan(spark, sf):
    plan = pacing.dispatch_plan(inputs.request_log(spark, sf), *LIMITS)
    return plan.select("client", "request_id", "tokens", "over_limit", micros("dispatch_at").alias("dispatch_at"))


@query
def dispatch_minutes(spark, sf):
    """What the plan sends in each minute, held against the limits."""
    plan = pacing.dispatch_plan(inputs.request_log(spark, sf), *LIMITS).filter("not over_limit")
    early = F.count_if(F.col("dispatch_at") < F.col("ts"))
    minute = F.floor(micros("dispatch_at") / pacing.MINUTE).alias("minute")
    sent = plan.groupBy("client", minute).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests"), early.alias("early"))
    within = (F.col("tokens") <= LIMITS[0]) & (F.col("requests") <= LIMITS[1])
    return sent.select("client", "minute", "tokens", "requests", "early", within.alias("within"))


@query
def quota_by_minute(spark, sf):
    q = pacing.quota_by_window(inputs.request_log(spark, sf), "1 minute", 5_000, 1)
    return q.withColumn("window_start", micros("window_start"))


@query
def quota_by_day(spark, sf):
    q = pacing.quota_by_window(inputs.request_log(spark, sf), "1 day", 500_000, 300, ("client",))
    return q.withColumn("window_start", micros("window_start"))


# --- whole runs ---


@query
def job_documents(spark, sf):
    return run_job(spark, inputs.documents(spark, sf), TEXT, Identity()).documents.select("doc_id", "n_chunks", "output_text", "status")


@query
def job_failures(spark, sf):
    refuse = Scripted(fail_when=lambda chunk: chunk.startswith("D"), message="refused")
    return run_job(spark, inputs.documents(spark, sf), TEXT, refuse).failures.select("doc_id", "chunk_number", "error")


@query
def job_summary(spark, sf):
    """A run in which some documents fail wholly, some in part and some are empty."""
    refuse = Scripted(fail_when=lambda chunk: chunk.startswith("D"), message="refused")
    summary = run_job(spark, inputs.documents(spark, sf), TEXT, refuse).summary
    return summary.select("successful", "failed", "total_output_tokens")


@query
def folder_outputs(spark, sf):
    """Files of a folder tree, written in capitals to another one; what the pattern leaves out has no output."""
    source, target = inputs.written_folder(spark, sf), fresh_path(spark, "outputs")
    run_folder(spark, source, JobConfig(data_format="text", chunk_size=CS, sample_size=SAMPLE, recurse="*.md"), Upper(), target)
    made = store.read_manifest(manifest.list_files(spark, target))
    return made.select(F.expr("substr(path, instr(path, 'outputs-') + 41)").alias("rel_path"), "text")


@query
def resumed_run(spark, sf):
    """A run over half of the documents, then one over all: the second asks for the other half only."""
    docs, log = inputs.documents(spark, sf), fresh_path(spark, "log")
    run_job(spark, docs.filter("doc_id % 2 = 0"), TEXT, Identity("first"), log_dir=log)
    whole = run_job(spark, docs, TEXT, Identity("second"), log_dir=log)
    models = whole.responses.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))
    return whole.documents.join(models, "doc_id", "left").select("doc_id", "output_text", "models")


@query
def run_progress_query(spark, sf):
    """What the log of a run holds; a run with failed chunks."""
    log, refuse = fresh_path(spark, "log"), Scripted(fail_when=lambda chunk: chunk.startswith("D"), message="refused")
    run_job(spark, inputs.documents(spark, sf), TEXT, refuse, log_dir=log)
    return run_progress(spark, log).select("answers", "failed_answers", "documents", "chunk_tokens")


# --- text repair ---


@query
def dehyphenate(spark, sf):
    return inputs.broken_documents(spark, sf).select("doc_id", text_repair.dehyphenate("text").alias("text"))


@query
def clean_spacing(spark, sf):
    return inputs.broken_documents(spark, sf).select("doc_id", text_repair.clean_spacing("text").alias("text"))


@query
def drop_page_numbers(spark, sf):
    return inputs.broken_documents(spark, sf).select("doc_id", text_repair.drop_page_numbers("text").alias("text"))


@query
def drop_garble(spark, sf):
    return inputs.broken_documents(spark, sf).select("doc_id", text_repair.drop_garble("text").alias("text"))


@query
def merge_lines(spark, sf):
    return inputs.broken_documents(spark, sf).select("doc_id", text_repair.merge_lines("text").alias("text"))


@query
def drop_repeated_lines(spark, sf):
    return text_repair.drop_repeated_lines(inputs.documents(spark, sf, "source"), least_docs=3, percent=2).select("doc_id", "text", "n_dropped")


# --- reports ---


@query
def chunk_stats(spark, sf):
    return reports.chunk_stats(inputs.chunks(spark, sf), "doc_id")


@query
def chunk_stats_by_language(spark, sf):
    return reports.chunk_stats(inputs.chunks(spark, sf, "lang"), "lang")


@query
def dry_run_report(spark, sf):
    return reports.dry_run_report(inputs.chunks(spark, sf), "text", 12)


@query
def doc_state(spark, sf):
    return reports.with_status(reports.doc_state(inputs.responses(spark, sf))).drop("first_error")


@query
def run_summary(spark, sf):
    return reports.run_summary(reports.with_status(reports.doc_state(inputs.responses(spark, sf))))


@query
def zero_output_docs(spark, sf):
    r = inputs.responses(spark, sf)
    lost = F.col("doc_id") % 9 == 0
    r = r.withColumn("error", F.when(lost, "server error: down").otherwise(F.col("error")))
    return reports.zero_output(r)


@query
def throughput(spark, sf):
    state = reports.doc_state(inputs.responses(spark, sf, "lang"), "lang")
    return reports.throughput(state, "lang").withColumn("tokens_per_second", F.round("tokens_per_second", 6))


@query
def model_usage(spark, sf):
    return reports.model_usage(inputs.responses(spark, sf))


@query
def failures(spark, sf):
    return reports.failures(inputs.responses(spark, sf))


@query
def progress(spark, sf):
    return reports.progress(inputs.chunks(spark, sf))


@query
def topk_preview(spark, sf):
    c = inputs.chunks(spark, sf, "source").select("source", "doc_id", "chunk_index", "token_count")
    c = durable(c, "preview")  # read twice, packed once
    order = [F.desc("token_count"), F.asc("doc_id"), F.asc("chunk_index")]
    return reports.top_per_group(c, "source", order, 3)


# --- streams ---


def _document_stream(spark, sf, name="documents", *columns):
    inputs.utc(spark)
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # A table is one file or a folder of them.  A stream takes a plain path for a folder, and what a glob matches for either.
    return read_stream(spark, f"{sf}/{{{name}}}.parquet", schema).select(*columns)


@query
def stream_chunks_query(spark, sf):
    docs = _document_stream(spark, sf, "documents", "doc_id", "text")
    return drain(stream_chunks(docs, TEXT).select(*CHUNK), "chunks")


@query
def stream_continuity(spark, sf):
    docs = _document_stream(spark, sf, "documents", "doc_id", "text")
    states = drain(track_documents(stream_chunks(docs, TEXT), SAMPLE, None), "states")
    # Later micro-batches supersede earlier ones.
    last = F.max_by(F.struct("tokens", "last_index", "last_text"), "chunks")
    return states.groupBy("doc_id").agg(F.max("chunks").alias("chunks"), last.alias("s")).select("doc_id", "chunks", "s.*")


@query
def stream_quota_query(spark, sf):
    e = _document_stream(spark, sf, "events", "ts", "value")
    log = e.select("ts", F.floor(F.col("value") * 100).cast("bigint").alias("tokens"))
    q = drain(stream_quota(log, "1 minute", "5 minutes", 5_000, 1), "quota")
    return q.withColumn("window_start", micros("window_start"))


@query
def stream_dedup_outputs(spark, sf):
    base = fresh_path(spark, "dedup")
    for attempt in ("first", "again"):
        docs = _document_stream(spark, sf, "documents", "doc_id", "text")
        q = start_deduplicated(docs, base + "/out", f"{base}/{attempt}", buckets=8)
        if q.awaitTermination() is False:
            q.stop()
            raise TimeoutError("stream_dedup_outputs")
        # The second run has a new checkpoint and sees every document again.
    return spark.read.parquet(base + "/out").select("doc_id", "text")


# --- SQL names ---


@query
def sql_functions(spark, sf):
    register_functions(spark)
    inputs.documents(spark, sf).createOrReplaceTempView("folio_documents")
    return spark.sql(
        f"""SELECT doc_id, token_count(text) AS tokens, completion_budget(token_count(text), 100) AS budget,
                   piece_index, piece, piece_tokens
            FROM folio_documents, LATERAL split_overlong(text, {CS})"""
    )


@query
def sql_chunk_text(spark, sf):
    register_functions(spark)
    inputs.documents(spark, sf).createOrReplaceTempView("folio_documents")
    return spark.sql(
        f"""SELECT doc_id, chunk_index, chunk AS text, chunk_tokens AS token_count
            FROM folio_documents, LATERAL chunk_text(text, {CS})"""
    )
