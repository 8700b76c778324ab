"""Composed jobs and the driver catalog (queries + DuckDB oracles)."""
