"""Long-document processing on Spark."""

import sys

from pyspark import cloudpickle

from .config import ApiError, ChunkingError, ConfigError, FolioError, JobConfig, ModelSpec
from .functions.sql import register_functions
from .functions.tokens import ArrowTokenCounter, TokenCounter, token_count
from .operators.registry import create_chunks, register_strategy
from .operators.responders import Constant, Identity, Responder, Scripted, Upper
from .plans.job import JobResult, run_folder, run_job

# Functions of this package travel to Python workers by value, so workers need not
# be able to import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ApiError", "ArrowTokenCounter", "ChunkingError", "ConfigError", "Constant", "FolioError",
    "Identity", "JobConfig", "JobResult", "ModelSpec", "Responder", "Scripted", "TokenCounter",
    "Upper", "create_chunks", "register_functions", "register_strategy", "run_folder", "run_job", "token_count",
]
