"""Sequence, interval and report formats."""
