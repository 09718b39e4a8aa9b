"""Readers of text tables and sparse count matrices."""
