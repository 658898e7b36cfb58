"""Queries by name, with their SQL.

The SQL is written as named steps; a query's text takes in the steps it names,
and those that these name in turn.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STEPS: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    STEPS[name] = sql.strip()


def with_steps(sql: str) -> str:
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(STEPS[name])

    visit(sql)
    steps = ",\n".join(f"{name} AS (\n{STEPS[name]}\n)" for name in STEPS if name in needed)
    return f"WITH {steps}\n{sql.strip()}" if steps else sql.strip()


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_steps(sql)
        return run

    return register
