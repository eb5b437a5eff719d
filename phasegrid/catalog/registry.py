"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Tables, with_views

_DUCK = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
DIGITS = 6


@dataclass
class Query:
    name: str
    columns: list[tuple[str, str]]
    run: Callable[[Tables], DataFrame]
    sql: str | None
    needs: list[str]


QUERIES: dict[str, Query] = {}
VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: list[str], sql: str) -> None:
    """A common table expression for oracles only."""
    VIEWS[name] = (needs, sql)


def query(name: str, columns: str, needs: list[str] | None = None, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``columns`` is "name type, ..." and holds for both engines.

    Doubles are rounded to six decimals on both sides.
    """
    parsed = [tuple(c.strip().rsplit(" ", 1)) for c in columns.split(",")]

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = Query(name, parsed, fn, sql, needs or [])
        return fn

    return add


def _spark_column(name: str, kind: str):
    c = F.col(f"`{name}`").cast(kind)
    return (F.round(c, DIGITS) if kind == "double" else c).alias(name)


def run_query(q: Query, spark: SparkSession, folder: str) -> DataFrame:
    return q.run(Tables(spark, folder)).select(*[_spark_column(n, k) for n, k in q.columns])


def oracle(q: Query) -> str:
    parts = []
    for name, kind in q.columns:
        value = f'CAST("{name}" AS {_DUCK[kind]})'
        parts.append(f'{f"round({value}, {DIGITS})" if kind == "double" else value} AS "{name}"')
    body = f"SELECT {', '.join(parts)}\nFROM (\n{q.sql.strip()}\n) answer"
    return with_views(body, q.needs, VIEWS)
