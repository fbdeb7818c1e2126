"""Structured Streaming: scoring new customer files as they arrive."""
