"""Structured Streaming jobs; each has a batch twin built from the same
transformation, used by the oracle comparison and the tests."""
