"""Pipes over streams."""

from millrace.streaming.runner import run_stream, stream_files

__all__ = ["run_stream", "stream_files"]
