"""Which files to process: discovery, filters, resume."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHECKPOINT_MAX_AGE_HOURS
from ..functions.tokens import col
from ..session import durable
from .paths import below_git, expand_braces, is_ignored, matches_any, output_path

# Fixed value: the largest file accepted by the size guard.
MAX_FILE_BYTES = 100 * 1024 * 1024
#: Tasks that list the folders of one level, at most.
LIST_TASKS = 256


def rooted(folder: str) -> str:
    """The folder as an absolute path or URI without a trailing slash; ``file:`` URIs become plain paths."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return folder.rstrip("/") or "/" if "://" in folder else os.path.abspath(folder)


def list_files(spark: SparkSession, input_dir: str) -> DataFrame:
    """Every file below a folder, whatever its name or size: path, rel_path, length, modified.

    Folders are listed by tasks, one level of the tree at a time, so neither names nor sizes pass through the driver.
    Contents are not read.  Links to folders are not followed, so a loop of links ends; links to files are listed.
    """
    root = rooted(input_dir)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch["path"]:
                store, name = fs.FileSystem.from_uri(folder)
                prefix = folder[: len(folder) - len(name)] if folder.endswith(name) else ""
                found = store.get_file_info(fs.FileSelector(name))
                if isinstance(store, fs.LocalFileSystem):
                    found = [i for i in found if i.type != fs.FileType.Directory or not os.path.islink(i.path)]
                rows = [
                    (prefix + i.path, i.size, i.mtime, i.type == fs.FileType.Directory)
                    for i in found
                    if i.type in (fs.FileType.File, fs.FileType.Directory)
                ]
                out = pd.DataFrame(rows, columns=["path", "length", "modified", "folder"])
                out["length"], out["modified"] = out["length"].astype("Int64"), pd.to_datetime(out["modified"], utc=True)
                yield out.astype({"folder": bool})

    level = spark.createDataFrame([(root,)], "path string")
    found, n = None, 1
    while n:
        listed = level.repartition(min(n, LIST_TASKS), "path").mapInPandas(
            entries, "path string, length bigint, modified timestamp, folder boolean"
        )
        listed = durable(listed, "listing")
        files = listed.filter(~F.col("folder")).drop("folder")
        found = files if found is None else found.unionByName(files)
        level = listed.filter("folder").select("path")
        n = level.count()
    mark = root.rstrip("/") + "/"
    return found.select("path", F.substring("path", F.lit(len(mark) + 1), F.length("path")).alias("rel_path"), "length", "modified")


def folder_exists(path: str) -> bool:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(rooted(path))
    return store.get_file_info(name).type == fs.FileType.Directory


def discover(
    files: DataFrame,
    pattern: str,
    output_dir: str | None = None,
    ignore_lines: list[str] | None = None,
    unrestricted: bool = False,
) -> DataFrame:
    """Path table to manifest: pattern, ``.git`` and ignore filters, output path.

    One narrow pass.  A path that matches several patterns appears once.
    """
    keep = matches_any("rel_path", expand_braces(pattern)) & ~below_git("rel_path")
    if ignore_lines and not unrestricted:
        keep = keep & ~is_ignored("rel_path", ignore_lines)
    return files.filter(keep).withColumn("output_path", output_path("rel_path", output_dir, "path"))


def prescreen(manifest: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Drop pairs whose output exists, unless the output is the input itself.

    ``existing`` is a table with a ``path`` column.  An in-place pair gets a null
    probe, which matches nothing.
    """
    if force:
        return manifest
    probe = F.when(F.col("output_path") != F.col("path"), F.col("output_path"))
    done = existing.select(F.col("path").alias("_done"))
    return manifest.join(done, probe == F.col("_done"), "left_anti")


def pending(items: DataFrame, completed: DataFrame, now: Column, key: str = "doc_id",
            max_age_hours: float = CHECKPOINT_MAX_AGE_HOURS) -> DataFrame:
    """Items not completed recently; older completion records are ignored."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("completed_at"))) / F.lit(3_600_000_000.0)
    fresh = completed.filter(age <= max_age_hours).select(key)
    return items.join(fresh, key, "left_anti")


def size_guard(files: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """Mark files over the limit, before any content is read."""
    return files.withColumn(
        "error",
        F.when(
            F.col("length") > limit,
            F.concat(F.lit("File too large: "), F.col("length").cast("string"), F.lit(f" bytes > {limit}")),
        ),
    )


def expand_pattern(pattern: Column | str) -> Column:
    """:func:`expand_braces` over a column of patterns."""

    @F.pandas_udf("array<string>")
    def expand(patterns: pd.Series) -> pd.Series:
        return patterns.map(expand_braces, na_action="ignore")

    return expand(col(pattern))
