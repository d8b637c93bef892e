"""Structured Streaming forms of the quote tables."""
