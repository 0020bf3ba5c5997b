"""Registry of queries: a name, a callable over the stand-in tables and, where exact, SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from curatrix.checks.standins import COMMON_SQL, Tables

MODULES = ("scalars", "extraction", "shaping", "aggregation", "ranking", "scoring", "similarity", "modelling", "reporting", "arriving")


@dataclass(frozen=True)
class Check:
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Check] = {}


def check(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``. ``sql`` may start with ``, cte AS (...)`` and can use
    every stand-in table of ``COMMON_SQL``."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Check(fn, None if sql is None else f"WITH {COMMON_SQL}\n{sql.strip()}")
        return fn

    return wrap


def load_all() -> dict[str, Check]:
    for module in MODULES:
        importlib.import_module(f"curatrix.checks.{module}")
    return REGISTRY


def runner(entry: Check) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: entry.run(Tables(spark, sf_dir))
