"""Structured Streaming forms of the batch measures."""
