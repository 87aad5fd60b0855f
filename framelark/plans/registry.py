"""Registered queries, each with its SQL twin where SQL can state it."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(column: Column | str) -> Column:
    """Six decimals and no negative zero, as the SQL twins write it."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6) + F.lit(0.0)


def channels(prefix: str, width: int, start: int = 0, source: str = "feats"):
    """Scalar columns ``<prefix>0 ..`` out of consecutive channels."""
    return [
        r6(F.get(source, F.lit(start + i))).alias(f"{prefix}{i}") for i in range(width)
    ]
