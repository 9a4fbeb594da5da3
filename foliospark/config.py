"""Job parameters and fixed limits."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

# Model limits, in tokens.
MAX_CONTEXT_TOKENS = 131_000
MAX_OUTPUT_TOKENS = 40_000
MIN_COMPLETION_TOKENS = 4_096
REASONING_PERCENT = 450

# Chunking strategies and metadata fields.
DATA_FORMATS = ("text", "semantic", "markdown", "code", "xml")
REQUIRED_FIELDS = ("title", "author", "id", "type", "date")

# Rate limiting.
TOKENS_SAFETY_MARGIN = 50_000
REQUESTS_SAFETY_MARGIN = 100
CHECKPOINT_MAX_AGE_HOURS = 24


class FolioError(Exception):
    """Base class of all errors raised by this package."""


class ChunkingError(FolioError):
    """Unknown strategy or impossible chunk size."""


class ConfigError(FolioError):
    """A job parameter is out of bounds."""


class ApiError(FolioError):
    """A responder failed; ``status`` is the code of its answer, if there was one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class ModelSpec:
    """One entry of the model chain."""

    name: str
    max_output_tokens: int = MAX_OUTPUT_TOKENS
    enabled: bool = True


@dataclass(frozen=True)
class JobConfig:
    """Parameters of one run."""

    data_format: str = "markdown"
    chunk_size: int = 32_000
    sample_size: int = 200
    max_tokens_ratio: int = 100
    temp: float = 0.98
    top_p: float = 0.8
    prompt: str = ""
    model: str = "primary"
    fallbacks: tuple[ModelSpec, ...] = ()
    max_retry_attempts: int = 2
    explain: bool = False
    dry_run: bool = False
    force: bool = False
    recurse: str | None = None
    unrestricted: bool = False
    # How semantic and markdown cut: "structure" uses text structure, "lines" packs lines.
    splitter: str = "structure"
    # "reference" keeps known oddities of the original behaviour, "fixed" drops them.
    quirks: str = "fixed"
    workers: int | None = None
    # A TokenCounter; None estimates by characters.
    counter: Any = None
    # "headers" waits between calls as the headers of the last answer ask; "off" leaves that to the responder.
    pacing: str = "off"
    # Characters of a first chunk that a metadata request shows.
    explain_chars: int = 4_000

    def __post_init__(self) -> None:
        errors = []
        if not 0 < self.chunk_size <= MAX_CONTEXT_TOKENS:
            errors.append(f"chunk_size must be between 1 and {MAX_CONTEXT_TOKENS}")
        if self.sample_size < 0:
            errors.append("sample_size must be non-negative")
        if self.max_tokens_ratio < 1:
            errors.append("max_tokens_ratio must be at least 1")
        if not 0.0 <= self.temp <= 2.0:
            errors.append("temp must be between 0 and 2")
        if not 0.0 <= self.top_p <= 1.0:
            errors.append("top_p must be between 0 and 1")
        if self.workers is not None and self.workers <= 0:
            errors.append("workers must be positive")
        if self.splitter not in ("structure", "lines"):
            errors.append("splitter must be 'structure' or 'lines'")
        if self.pacing not in ("off", "headers"):
            errors.append("pacing must be 'off' or 'headers'")
        if self.quirks not in ("fixed", "reference"):
            errors.append("quirks must be 'fixed' or 'reference'")
        if errors:
            raise ConfigError("; ".join(errors))

    @property
    def prompt_tokens(self) -> int:
        return len(self.prompt) // 4 + 1 if self.counter is None else self.counter.measure().count(self.prompt)
