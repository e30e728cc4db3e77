"""Registered queries, their parameters and their DuckDB oracle SQL."""
