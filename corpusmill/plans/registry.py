"""Named queries and their SQL, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one directory, read when first named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Registers a function of (tables) under a name; sql gives the same rows in DuckDB."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def phrase(phrases: tuple[str, ...], by: Column) -> Column:
    """One of the phrases for each row, by a whole number."""
    return F.element_at(F.array(*map(F.lit, phrases)), F.pmod(by, F.lit(len(phrases))).cast("int") + 1)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_phrase(phrases: tuple[str, ...], by: str) -> str:
    return f"{sql_list(phrases)}[({by}) % {len(phrases)} + 1]"
