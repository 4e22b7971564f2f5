"""Named queries and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Fact tables with their time in seconds, for use after WITH.
O = "o AS (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders)"  # noqa: E741
L = "l AS (SELECT *, CAST(epoch(l_shipdate) AS BIGINT) AS t FROM lineitem)"
EV = "ev AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS t FROM events)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if there is any."""

    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register
