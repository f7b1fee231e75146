"""Structured Streaming jobs over append-only events."""
