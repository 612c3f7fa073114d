"""Registration helper and the per-call context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewinds.plans.warehouse import Warehouse
from tradewinds.sources.driver_tables import DriverTables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


class Context(Warehouse):
    """The lazy warehouse over one folder of driver tables, plus that folder and the session."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(DriverTables(spark, folder).raw)
        self.spark = spark
        self.folder = folder


def query(name: str) -> Callable[[Callable[[Context], DataFrame]], Callable[[Context], DataFrame]]:
    def register(build: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = lambda spark, folder: build(Context(spark, folder))
        return build

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)
