"""Sequences from tables, counters and views over other sequences."""
