"""Named queries: a Spark callable over a data folder and, where SQL can say it, the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proplake.sources.adapters import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str, ctes: str = "", recursive: bool = False):
    """Register ``fn(tables) -> DataFrame``; ``views`` are the adapter views the checking SQL reads."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, *views, ctes=ctes, recursive=recursive)
        return fn

    return register


MODULES = ["scoring", "serving", "features", "snapshots", "matching", "enrichment", "lifecycle", "calibration", "pages", "streams"]


def load_all() -> None:
    import importlib

    for name in MODULES:
        importlib.import_module(f"proplake.plans.{name}")
