"""Profiles of column values and of group sizes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewinds.functions import clean_text, is_digits, is_unparseable_ts, percent, text_bytes
from tradewinds.operators.aggregates import mode_by_key, one_row_to_long
from tradewinds.operators.joins import lookup_join

PROFILE_TYPE = "decimal(20,6)"


def null_blank_counts(df: DataFrame, columns: Sequence[str], cleaned: bool = False) -> DataFrame:
    """Per column: NULLs, blanks, either. With ``cleaned`` text that cleans to '' is blank too."""
    kinds = dict(df.dtypes)

    def row(name: str) -> dict[str, Column]:
        missing = F.count_if(F.col(name).isNull())
        text = clean_text(name) if cleaned else F.col(name)
        blank = F.count_if(text == "") if kinds[name] == "string" else F.lit(0).cast("long")
        return {"column_name": F.lit(name), "null_cnt": missing, "blank_cnt": blank, "missing_cnt": missing + blank}

    return one_row_to_long(df, [row(c) for c in columns])


def parse_failure_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: non-blank text that is not a timestamp."""
    return one_row_to_long(
        df,
        [{"column_name": F.lit(c), "parse_fail_cnt": F.count_if(is_unparseable_ts(c))} for c in columns],
    )


def value_distribution(df: DataFrame, value: Column | str, name: str = "value") -> DataFrame:
    """Rows per (normalised) value. Sort at the sink if an order is wanted."""
    value = F.col(value) if isinstance(value, str) else value
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("cnt"))


def value_share(df: DataFrame, value: Column | str, name: str = "value") -> DataFrame:
    """Rows per value and their percentage of all rows.

    The total is a scalar subquery over the distribution, whose shuffle serves both, not an unpartitioned window.
    """
    counts = value_distribution(df, value, name)
    total = counts.agg(F.sum("cnt")).scalar()
    return counts.select(name, "cnt", percent(F.col("cnt"), total).alias("cnt_pct"))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: NULL, negative and zero counts, minimum and maximum."""
    return one_row_to_long(
        df,
        [
            {
                "column_name": F.lit(c),
                "null_cnt": F.count_if(F.col(c).isNull()),
                "negative_cnt": F.count_if(F.col(c) < 0),
                "zero_cnt": F.count_if(F.col(c) == 0),
                "min_value": F.min(c).cast(PROFILE_TYPE),
                "max_value": F.max(c).cast(PROFILE_TYPE),
            }
            for c in columns
        ],
    )


def count_of_counts(df: DataFrame, key: str, distinct: Column | None = None) -> DataFrame:
    """Histogram of group sizes: how many keys have n rows (or n distinct values of an expression)."""
    if distinct is None:
        sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"))
    else:
        sizes = df.groupBy(key).agg(F.count_distinct(distinct).alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("key_cnt"))


def top_n_groups(
    df: DataFrame, key: str, n: int, order_by: Sequence[Column] | None = None, **measures: Column
) -> DataFrame:
    """The n largest groups. Default measure and order: row count, descending; ties by key."""
    measures = measures or {"cnt": F.count(F.lit(1))}
    order = list(order_by or [F.col(next(iter(measures))).desc()])
    grouped = df.groupBy(key).agg(*[c.alias(name) for name, c in measures.items()])
    return grouped.orderBy(*order, F.col(key)).limit(n)


def string_shape(df: DataFrame, column: str, expected_bytes: int | None = None) -> DataFrame:
    """Byte lengths and digit check of cleaned, non-blank text."""
    text = clean_text(column, blank_to_null=True)
    size = text_bytes(text)
    wrong = F.lit(0).cast("long") if expected_bytes is None else F.count_if(size != expected_bytes)
    return df.agg(
        F.min(size).alias("min_len"),
        F.max(size).alias("max_len"),
        F.count_if(~is_digits(text)).alias("non_numeric_cnt"),
        wrong.alias("wrong_len_cnt"),
    )


def normalisation_effect(df: DataFrame, columns: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Distinct (combinations of) values before and after cleaning; NULL parts are skipped.

    Rows collapse to the distinct raw values first, the cleaned ones are counted among those.
    """
    raw = df.select(*columns).dropna().distinct()
    return raw.agg(
        F.count(F.lit(1)).alias("raw_distinct"),
        F.count_distinct(*[clean(F.col(c)) for c, clean in columns.items()]).alias("norm_distinct"),
    )


def multi_mapped_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that map to more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("value_cnt")).filter("value_cnt > 1")


def multi_mapped_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Drill-down of ``multi_mapped_keys``: how often each value occurs under such a key."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("cnt"))
    wide = counts.groupBy(key).agg(F.count(value).alias("value_cnt")).filter("value_cnt > 1")
    return lookup_join(counts, wide.select(key), key)


def row_filter_listing(df: DataFrame, condition: Column | str, columns: Sequence[str] = ("*",)) -> DataFrame:
    """Rows meeting a predicate; the predicate reaches the scan."""
    return df.filter(condition).select(*columns)


def mode_confidence(points: DataFrame, key: str, value_cols: Sequence[str], valid: Column) -> DataFrame:
    """Per key: rows, rows at the most frequent valid value, and their percentage."""
    totals = points.groupBy(key).agg(F.count(F.lit(1)).alias("row_cnt"))
    modes = mode_by_key(points.filter(valid), key, value_cols, "mode_cnt").select(key, "mode_cnt")
    return totals.join(modes, key).select(
        key, "row_cnt", "mode_cnt", percent(F.col("mode_cnt"), F.col("row_cnt")).alias("mode_ratio_pct")
    )


def mode_confidence_summary(df: DataFrame, ratio: str, threshold: int) -> DataFrame:
    """How many keys have a mode share below ``threshold`` percent."""
    return df.agg(
        F.count_if(F.col(ratio) < threshold).alias("low_mode_cnt"), F.count(F.lit(1)).alias("total_cnt")
    ).select("*", percent(F.col("low_mode_cnt"), F.col("total_cnt")).alias("low_mode_pct"))


def counts_of(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row with the number of rows meeting each named condition."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
