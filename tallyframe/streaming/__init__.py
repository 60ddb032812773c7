"""Continuous ingest and incremental state."""
