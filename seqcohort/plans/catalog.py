"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    """Fill the catalog. Functions that run in Python workers are sent by value, so the
    package need not be installed on the executors."""
    import seqcohort
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(seqcohort)
    from seqcohort.plans import (  # noqa: F401
        queries_cohort, queries_evaluate, queries_fits, queries_founder, queries_pairs, queries_scalars, queries_sites,
        queries_sources,
    )
