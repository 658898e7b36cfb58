"""Imports every query module, which registers its queries."""

from workload import flight_queries, daily_queries, grid_queries, table_queries  # noqa: F401, I001
