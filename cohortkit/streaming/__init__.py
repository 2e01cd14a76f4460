"""Structured Streaming: exactly-once incremental load of raw files."""

from .loader import incremental_load  # noqa: F401
