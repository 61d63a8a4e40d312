"""Structured Streaming forms of mergeable aggregates."""
