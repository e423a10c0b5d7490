"""Structured Streaming forms of the operators."""
