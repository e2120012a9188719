"""Structured Streaming forms of the sync."""
