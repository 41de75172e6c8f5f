"""Structured Streaming ingestion: an addition to the batch operators."""
