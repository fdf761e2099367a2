"""Structured Streaming ingest."""

from .ingest import ingest, mutation_stream

__all__ = ["ingest", "mutation_stream"]
