"""The catalogue: named queries and, where SQL can state them, their DuckDB text."""
