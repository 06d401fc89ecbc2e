"""Incremental, resumable output with Structured Streaming."""
