"""Structured Streaming jobs over an append-only entry log."""
