"""Structured Streaming form of the incremental update."""
