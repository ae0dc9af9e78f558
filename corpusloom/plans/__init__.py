"""Configuration and reading plans."""
