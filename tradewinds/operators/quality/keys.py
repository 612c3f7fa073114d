"""Key uniqueness and key completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewinds.functions import is_blank


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def key_label(keys: Sequence[str]) -> str:
    return keys[0] if len(keys) == 1 else f"({', '.join(keys)})"


def any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def missing_values(null_cols: Sequence[str], blank_cols: Sequence[str]) -> Column:
    """Aggregate: NULLs of the first columns plus NULLs and blanks of the second ones."""
    counts = [F.count_if(F.col(c).isNull()) for c in null_cols]
    counts += [F.count_if(F.col(c).isNull() | (F.trim(c) == "")) for c in blank_cols]
    return reduce(lambda a, b: a + b, counts)


def unique_key_profile(df: DataFrame, key: str) -> DataFrame:
    """cnt, distinct_cnt, dup_cnt = cnt - distinct_cnt, blank_cnt of one key column."""
    column = F.col(key)
    blank = is_blank(key) if dict(df.dtypes)[key] == "string" else column.isNull()
    return df.agg(
        F.count(F.lit(1)).alias("cnt"),
        F.count_distinct(column).alias("distinct_cnt"),
        F.count_if(blank).alias("blank_cnt"),
    ).select("cnt", "distinct_cnt", (F.col("cnt") - F.col("distinct_cnt")).alias("dup_cnt"), "blank_cnt")


def composite_unique_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``unique_key_profile`` for several columns; rows with a NULL part are not distinct keys."""
    return df.agg(
        F.count(F.lit(1)).alias("cnt"),
        F.count_distinct(*keys).alias("distinct_cnt"),
        F.count_if(any_null(keys)).alias("blank_cnt"),
    ).select("cnt", "distinct_cnt", (F.col("cnt") - F.col("distinct_cnt")).alias("dup_cnt"), "blank_cnt")


def duplicate_key_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of key values that occur more than once."""
    return df.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("dup_cnt"))


def pk_uniqueness_summary(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per table: key columns and number of rows beyond the distinct keys."""
    return union_all(
        [
            df.agg((F.count(F.lit(1)) - F.count_distinct(*keys)).alias("dup_cnt")).select(
                F.lit(name).alias("table_name"), F.lit(key_label(keys)).alias("pk_cols"), "dup_cnt"
            )
            for name, (df, keys) in tables.items()
        ]
    )


def pk_null_summary(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per table: rows with a NULL key part."""
    return union_all(
        [
            df.agg(F.count_if(any_null(keys)).alias("pk_null_cnt")).select(
                F.lit(name).alias("table_name"), F.lit(key_label(keys)).alias("pk_cols"), "pk_null_cnt"
            )
            for name, (df, keys) in tables.items()
        ]
    )


def critical_null_summary(
    tables: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]],
) -> DataFrame:
    """Per table: missing values summed over its critical columns.

    A spec is (frame, columns where NULL counts, columns where blank text counts as well).
    """
    parts = []
    for name, (df, null_cols, blank_cols) in tables.items():
        parts.append(
            df.agg(missing_values(null_cols, blank_cols).alias("critical_null_cnt")).select(
                F.lit(name).alias("table_name"),
                F.lit(", ".join([*null_cols, *blank_cols])).alias("critical_cols"),
                "critical_null_cnt",
            )
        )
    return union_all(parts)
