"""The list of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Ledger, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    """Register a function of the ledger tables under `name`, with its oracle statement."""

    def register(fn: Callable[[Ledger], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Ledger.at(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql, *tables)
        return fn

    return register
