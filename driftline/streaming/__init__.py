"""Structured Streaming forms of the track analytics; the batch operators are their expected results."""
