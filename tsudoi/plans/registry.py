"""Named queries over the driver tables, each with the SQL it must agree with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tsudoi.plans import domain
from tsudoi.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the tables and the domain views of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return domain.view(self.spark, self.folder, name)


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``oracle`` may use the domain views by name."""
    def wrap(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = domain.with_views(oracle)
        return fn
    return wrap
