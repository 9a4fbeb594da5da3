"""Chunking strategies by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..config import ChunkingError, JobConfig
from ..functions.tokens import exact
from .chunk_code import chunk_code
from .chunk_structure import chunk_markdown, chunk_semantic
from .chunk_text import chunk_paragraph, chunk_text
from .chunk_xml import chunk_xml, chunk_xml_children

Strategy = Callable[[DataFrame, JobConfig], DataFrame]

_STRATEGIES: dict[str, Strategy] = {
    "text": lambda d, c: chunk_text(d, c.chunk_size, c.counter),
    "semantic": lambda d, c: chunk_semantic(d, c.chunk_size, c.splitter, c.counter),
    "markdown": lambda d, c: chunk_markdown(d, c.chunk_size, c.splitter, c.counter),
    "code": lambda d, c: chunk_code(d, c.chunk_size, c.quirks, c.counter),
    "xml": lambda d, c: chunk_xml(d, c.chunk_size),
    "xml_children": lambda d, c: chunk_xml_children(d, c.chunk_size),
    "paragraph": lambda d, c: chunk_paragraph(d, c.chunk_size),
}


def register_strategy(name: str, strategy: Strategy) -> None:
    """Add a strategy: a function from (documents, config) to a chunk table."""
    _STRATEGIES[name] = strategy


def strategies() -> list[str]:
    return sorted(_STRATEGIES)


def _counts_characters(config: JobConfig) -> bool:
    """The structure and XML chunkers measure characters and would pass over a tokenizer."""
    by_structure = config.data_format in ("semantic", "markdown") and config.splitter == "structure"
    return by_structure or config.data_format in ("xml", "xml_children", "paragraph")


def create_chunks(docs: DataFrame, config: JobConfig) -> DataFrame:
    """Chunk a document table: its other columns plus chunk_index, n_chunks, text, token_count."""
    if config.data_format not in _STRATEGIES:
        raise ChunkingError(
            f"Unknown data_format: {config.data_format}. Must be one of: {strategies()}"
        )
    if exact(config.counter) and _counts_characters(config):
        raise ChunkingError(f"{config.data_format} can't use a token counter; text and code can, and others with splitter='lines'")
    return _STRATEGIES[config.data_format](docs, config)
