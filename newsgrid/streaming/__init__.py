"""Structured Streaming forms of the ingest and the daily rollups."""
