"""Readers of raw archives and records, and table writers."""
