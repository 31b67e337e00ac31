"""Structured Streaming versions of ingest, validation and progress tracking."""
