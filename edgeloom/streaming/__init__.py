"""Continuous ingestion and windowed aggregates over streams of edges."""
