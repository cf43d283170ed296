"""Structured Streaming jobs keeping aggregates and the comment store current."""
