"""Trace frames as a stream."""
