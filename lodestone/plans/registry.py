"""Where queries and the SQL that checks them are registered, and what their modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLE_SQL[function.__name__] = oracle
        return function

    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def strip_sql(t: str) -> str:
    return rf"regexp_replace({t}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def choice(number: Column, items: list[str]) -> Column:
    """One of some items, by a number; ``items[1 + number % len(items)]`` in SQL."""
    return F.get(F.array(*[F.lit(i) for i in items]), (number % len(items)).cast("int"))
