"""Registered queries of the detection and inspection operators, and their DuckDB twins."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import sightline.queries
from sightline.views import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with its DuckDB twin over the named views."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = oracle(sql, *views)
        return fn

    return keep


def load() -> None:
    for m in pkgutil.iter_modules(sightline.queries.__path__):
        importlib.import_module(f"sightline.queries.{m.name}")
