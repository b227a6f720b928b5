"""Structured Streaming forms of the operators (family S)."""
