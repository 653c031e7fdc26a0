"""Structured Streaming forms of the aggregating operators."""
