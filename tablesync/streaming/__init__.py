"""Structured Streaming versions of the loader and of change apply."""
