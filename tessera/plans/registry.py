"""The registry that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.bridge import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Star], DataFrame]], Callable[[Star], DataFrame]]:
    """Register a query over a Star, and the SQL that must give the same rows."""

    def add(f: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add
