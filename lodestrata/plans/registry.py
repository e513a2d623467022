"""Every registered query and its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str | None = None, sql: str | None = None, *ctes: str, recursive: bool = False):
    """Registers ``f(tables) -> DataFrame`` as query ``name``; with SQL, also its oracle over the named shapes."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(tables or "", sql, *ctes, recursive=recursive)
        return f

    return register


def load() -> None:
    """Imports every module that registers queries."""
    from . import catalog  # noqa: F401
