"""A table of named queries and of their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def case(self, sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        """Registers a query by its function's name, with the DuckDB SQL that returns the same rows.

        The columns in `dates` are returned as ISO text on both sides, whatever a client makes of dates.
        """

        def add(query: Query) -> Query:
            self.queries[query.__name__] = _dates_as_text(query, dates)
            if sql:
                texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
                self.sql[query.__name__] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if dates else sql
            return query

        return add


def _dates_as_text(query: Query, dates: tuple[str, ...]) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        return out.withColumns({c: out[c].cast("string") for c in dates}) if dates else out

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
