"""Structured Streaming forms of ingest, supersession and windows."""
