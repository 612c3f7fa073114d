"""Scratch folders, views and small table reports; stored tables are in ``storage``."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewinds.operators.aggregates import one_row_to_long
from tradewinds.operators.quality.keys import union_all
from tradewinds.sources.storage import conform, hadoop_path, overwrite_partitions, overwrite_table, read_table, stored_table

__all__ = [
    "conform",
    "overwrite_partitions",
    "overwrite_table",
    "read_table",
    "register_view",
    "row_count_report",
    "sample_rows",
    "schema_report",
    "scratch_folder",
    "shared_folder",
    "stored_table",
]

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by the cluster in ``spark.checkpoint.dir``.

    A local-mode session without the setting uses its warehouse folder.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        folder = spark.conf.get(WAREHOUSE_CONF, "spark-warehouse")
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the program ends."""
    path = f"{shared_folder(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        files, where = hadoop_path(spark, path)
        files.delete(where, True)
    except Exception:  # noqa: BLE001 - the session has ended before the program
        pass


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Make the frame available to SQL under ``name``."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def row_count_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(tbl, cnt): exact row counts."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(name).alias("tbl"), "cnt")
            for name, df in tables.items()
        ]
    )


def sample_rows(df: DataFrame, n: int, order_by: Sequence[Column | str] = ()) -> DataFrame:
    """The first n rows, of a given order if there is one (top-k per task, no full sort)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def schema_report(df: DataFrame) -> DataFrame:
    """Columns of a table as data: position, name, type, nullable, and the present values counted in one pass."""
    rows = [
        {
            "ordinal": F.lit(i),
            "column_name": F.lit(f.name),
            "data_type": F.lit(f.dataType.simpleString()),
            "is_nullable": F.lit(f.nullable),
            "present_cnt": F.count(f.name),
        }
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return one_row_to_long(df, rows)
