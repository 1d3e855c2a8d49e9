"""Registered queries, each with its DuckDB counterpart where SQL can express it."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docuvet import fixed
from docuvet.plans.derive import Inputs, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def re2(pattern: str) -> str:
    """A pattern of the fixed list for an engine without look-around: boundaries consume a character."""
    pattern = pattern.replace(fixed.B0, rf"(?:^|[^{fixed.WORD}])").replace(fixed.B1, rf"(?:$|[^{fixed.WORD}])")
    return "'" + pattern.replace("'", "''") + "'"


def query(name: str, oracle: str | None = None):
    """Register ``f(inputs)``; ``<input>`` in the oracle stands for a derived input."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = re.sub(r"<([a-z_]+)>", lambda m: duckdb_sql(m.group(1)), oracle)
        return f

    return register
