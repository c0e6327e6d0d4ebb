"""All queries of the library by name, and the SQL each can be held against."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import marlstone.plans as plans

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    return [importlib.import_module(f"marlstone.plans.{m.name}") for m in pkgutil.iter_modules(plans.__path__) if m.name.endswith("_queries")]


def queries() -> dict[str, Query]:
    return {name: f for module in _modules() for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
