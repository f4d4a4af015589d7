"""Registered queries (one per operator) and their DuckDB oracle texts."""
