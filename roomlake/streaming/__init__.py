"""Streaming ingest of scene files."""
