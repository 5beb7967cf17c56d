"""Structured Streaming jobs over readings."""
