"""Incremental ingestion of transcript lines with Structured Streaming."""
