"""Composed plans: the query registry and its DuckDB oracle SQL."""
