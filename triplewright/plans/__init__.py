"""Queries over the bundled tables, with their DuckDB equivalents."""
