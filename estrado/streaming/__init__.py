"""Structured Streaming: incremental ingest of norms (beyond the batch operators)."""
