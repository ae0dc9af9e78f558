"""Corpus-preparation analytics on Spark."""
