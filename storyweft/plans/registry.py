"""Registered queries: an operator applied to the logical tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyweft.sources.tables import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: str = "") -> Callable:
    """Register a function of :class:`Tables` under a name.

    ``sql`` may use the logical tables. Dates and times are returned as text; ``dates`` names those
    columns, for the SQL to do likewise.
    """

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = build(Tables(spark, folder))
            return df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind.startswith(("date", "timestamp"))})

        QUERIES[name] = run
        if sql:
            text = sql.strip()
            for start in ("WITH RECURSIVE ", "WITH "):
                if text.startswith(start):
                    text = ", " + text.removeprefix(start)
                    break
            text = SQL_VIEWS + text
            if dates:
                text = "SELECT * REPLACE (" + ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in dates.split()) + f") FROM ({text})"
            ORACLE_SQL[name] = text
        return build

    return add
