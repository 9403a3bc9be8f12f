"""Structured Streaming versions of the stateless cleaning steps."""
