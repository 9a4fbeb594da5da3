"""Document tables in and out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

#: Bytes and files that one task reads.
TASK_BYTES, TASK_FILES = 64 << 20, 2_000
#: Bytes and files that a task holds before it passes them on; a longer file stands alone.
BATCH_BYTES, BATCH_FILES = 1 << 20, 500


def read_table(spark: SparkSession, path: str, key: str, *columns: str) -> DataFrame:
    """A parquet document table, projected, over enough tasks."""
    return spread(spark.read.parquet(path).select(key, *columns), key)


def read_files(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Text files as rows: path, length, text, error.

    Files that are not UTF-8, or over ``limit`` bytes if one is given, become error rows, and the job goes on.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return decode_documents(raw, limit)


def read_manifest(manifest: DataFrame, limit: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Contents of exactly the files of a manifest: path, length, text, error.

    The manifest says little about the work, so the number of tasks comes from the bytes and the number of the files
    it names.  Files over a given limit are never opened, and a file that cannot be read becomes an error row.
    """
    total = manifest.agg(F.sum("length").alias("bytes"), F.count("*").alias("n")).first()
    tasks = max(1, -(-(total.bytes or 0) // task_bytes), -(-total.n // TASK_FILES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        rows, size = [], 0

        def held() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["path", "length", "content", "problem"])

        for batch in batches:
            for path, length in batch.itertuples(index=False, name=None):
                # Memory holds one document, or many small ones.
                if rows and (len(rows) >= BATCH_FILES or size + (0 if pd.isna(length) else length) > BATCH_BYTES):
                    yield held()
                    rows, size = [], 0
                data, problem = b"", None
                try:
                    if limit is None or length <= limit:
                        store, name = fs.FileSystem.from_uri(path)
                        with store.open_input_stream(name) as f:
                            data = f.read()
                except Exception as e:
                    problem = str(e)
                rows.append((path, length, data, problem))
                size += len(data)
        if rows:
            yield held()

    raw = (
        manifest.select("path", "length")
        .repartition(tasks, "path")
        .mapInPandas(run, "path string, length bigint, content binary, problem string")
    )
    decoded = decode_documents(raw, limit)
    return decoded.withColumn("error", F.coalesce("problem", "error")).drop("problem")


def decode_documents(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """``content BINARY`` to ``text``; CRLF and CR become LF as on a text read."""
    from ..functions.text import norm_newlines

    small = F.lit(True) if limit is None else F.col("length") <= limit
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(small & valid, norm_newlines(F.decode(F.col("content"), "UTF-8")))
    error = F.when(~small, F.lit("file too large")).when(~valid, F.lit("not valid UTF-8"))
    keep = [c for c in raw.columns if c != "content"]
    return raw.select(*keep, text.alias("text"), error.alias("error"))


def write_table(docs: DataFrame, path: str, mode: str = "error") -> None:
    """Write results as parquet; Spark's commit makes the table appear whole."""
    docs.write.mode(mode).parquet(path)


def write_files(docs: DataFrame, backup: bool = False) -> DataFrame:
    """One file per document at ``output_path``; a status row per document.

    Each task writes to a temporary name beside the target and renames, so a retry
    after a lost executor leaves no partial file.  Works on any file system that
    pyarrow reaches.  Lazy: nothing is written until the result is consumed once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        for batch in batches:
            rows = []
            for path, text in batch.itertuples(index=False, name=None):
                data = text.encode("utf-8")
                try:
                    store, name = fs.FileSystem.from_uri(path)
                    parent = name.rsplit("/", 1)[0]
                    store.create_dir(parent, recursive=True)
                    if backup and store.get_file_info(name).type != fs.FileType.NotFound:
                        store.copy_file(name, name + ".bak")
                    temp = f"{parent}/.{uuid.uuid4().hex}.tmp"
                    with store.open_output_stream(temp) as out:
                        out.write(data)
                    store.move(temp, name)
                    rows.append((path, len(data), None))
                except Exception as e:
                    rows.append((path, None, str(e)))
            out = pd.DataFrame(rows, columns=["output_path", "bytes", "error"])
            out["bytes"] = out["bytes"].astype("Int64")
            yield out

    return docs.select("output_path", "output_text").mapInPandas(
        run, "output_path string, bytes bigint, error string"
    )
