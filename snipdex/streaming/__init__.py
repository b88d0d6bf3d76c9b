"""Structured Streaming jobs over change records."""
