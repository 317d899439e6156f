"""Structured Streaming entry points (STR1)."""
