"""Queries over streams: an addition, the compiled plan being the same."""
