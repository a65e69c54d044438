"""Structured Streaming forms of keyed state."""
