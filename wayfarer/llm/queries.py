"""Queries of this subpackage and the SQL that expresses them, where SQL can."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules() -> list:
    package = importlib.import_module(__package__)
    names = sorted(m.name for m in pkgutil.iter_modules(package.__path__) if m.name.startswith("op"))
    return [importlib.import_module(f"{__package__}.{name}") for name in names]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
