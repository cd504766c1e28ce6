"""Structured Streaming jobs (ST2, ST3)."""
