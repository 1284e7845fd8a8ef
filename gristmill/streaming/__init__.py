"""Structured Streaming: incremental ingest, change tracking, weekly windows."""
