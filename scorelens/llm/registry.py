"""Names of the queries of this subpackage, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Steps of the CRC-32 of one byte, as a list.
CRC32_SQL = """
SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS steps
"""


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` computes the same rows from the same tables."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
