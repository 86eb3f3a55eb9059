"""Incremental loading of newly delivered extracts (Structured Streaming)."""
