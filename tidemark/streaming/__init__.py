"""Structured Streaming: incremental ingestion and bars from prints."""
