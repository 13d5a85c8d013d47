"""Incremental work with Structured Streaming."""
