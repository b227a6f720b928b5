"""Readers and writers (family A)."""
