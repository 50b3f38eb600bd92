"""Structured Streaming forms of the ingest (S1) and weekly counts (A1)."""
