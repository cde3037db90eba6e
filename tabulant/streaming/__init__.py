"""The batch operators on Structured Streaming sources."""

from .incremental import read_stream, run_available, windowed_mean

__all__ = ["read_stream", "run_available", "windowed_mean"]
