"""Registered queries: a Spark callable each and, where SQL can say it, the oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return add


def big(df: DataFrame, *columns: str) -> DataFrame:
    """Unsigned columns of small test values as plain BIGINT."""
    from pyspark.sql import functions as F
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})
