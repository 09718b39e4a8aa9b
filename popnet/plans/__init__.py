"""Whole runs, and the queries that show each operator on tables."""
