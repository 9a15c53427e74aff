"""Structured Streaming versions of additive operators."""
