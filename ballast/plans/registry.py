"""The registered queries and, where SQL can say the same, their SQL text."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its SQL twin if there is one."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def u_sql(purpose: str, *keys: str, seed: int = 42) -> str:
    """The SQL text of :func:`ballast.functions.draws.uniform`."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return (f"(CAST(CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{purpose}', {parts})), 1, 13) AS BIGINT) "
            f"AS DOUBLE) / CAST(4503599627370496 AS DOUBLE))")


def pick_sql(purpose: str, n: str, *keys: str, seed: int = 42) -> str:
    """The SQL text of :func:`ballast.functions.draws.pick`."""
    return f"CAST(floor({u_sql(purpose, *keys, seed=seed)} * CAST({n} AS DOUBLE)) + 1 AS BIGINT)"
