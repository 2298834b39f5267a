"""Operators bound to the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

MODULES = ["ranking", "sampling", "text", "metrics", "telemetry", "fleet", "flows"]


class Query(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def registry() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for m in MODULES:
        for name, q in importlib.import_module(f"trainframe.plans.{m}").QUERIES.items():
            if name in found:
                raise ValueError(f"query registered twice: {name}")
            found[name] = Query(*q)
    return found
