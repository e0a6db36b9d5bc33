"""Collects the queries and their SQL from the modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("retrieval", "evaluation", "catalog", "playlists", "dialogue", "streams")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"rankloom.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"rankloom.plans.{name}").SQL
    return found
