"""Structured Streaming: incremental ingest and windowed rates."""
