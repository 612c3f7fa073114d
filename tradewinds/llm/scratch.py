"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradewinds.sources.sinks import scratch_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, removed when the program ends.

    What follows starts from the table, so a lost executor costs a task and not the work before it, and columns that
    are not asked for are not read.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
