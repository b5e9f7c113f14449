"""Registered queries, their DuckDB oracle SQL and end-to-end jobs."""
