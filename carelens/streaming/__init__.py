"""Structured Streaming: the discharge ingest driven by files arriving in a landing folder."""

from carelens.streaming.ingest import new_files, start_ingest

__all__ = ["new_files", "start_ingest"]
