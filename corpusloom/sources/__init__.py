"""Readers and sinks of corpus tables."""
