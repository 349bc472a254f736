"""Structured Streaming: the same time windows over unbounded inputs."""

from .windows import read_stream, run_once, session_windows, tumbling

__all__ = ["read_stream", "run_once", "session_windows", "tumbling"]
