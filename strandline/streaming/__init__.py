"""Streaming additions: job records and scored frames as unbounded tables."""
