"""Invariants of month axes, cohort matrices and running totals.

The windows below run over the months of one cohort; a partition is as long as the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.operators.quality.keys import union_all


def month_axis_completeness(tables: Mapping[str, DataFrame], month: str = "year_month") -> DataFrame:
    """Per table: distinct months, first and last month."""
    return union_all(
        [
            df.agg(
                F.count_distinct(month).alias("month_cnt"), F.min(month).alias("min_month"), F.max(month).alias("max_month")
            ).select(F.lit(name).alias("table_name"), "month_cnt", "min_month", "max_month")
            for name, df in tables.items()
        ]
    )


def sum_identity(df: DataFrame, key: str, parts: list[str], whole: str) -> DataFrame:
    """Rows where the parts do not add up to the whole."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.filter(total != F.col(whole)).select(key, *parts, whole, (total - F.col(whole)).alias("diff"))


def sequence_gap(df: DataFrame, part: str, order: str) -> DataFrame:
    """Rows whose position within ``part`` (from 0) differs from their ``order`` number."""
    position = F.row_number().over(W.partitionBy(part).orderBy(order)) - 1
    return df.select(part, order, position.alias("position")).filter(F.col(order) != F.col("position"))


def constant_within_group(df: DataFrame, key: str, column: str) -> DataFrame:
    """Groups in which ``column`` takes more than one value."""
    return (
        df.groupBy(key)
        .agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))
        .filter(F.col("min_value") != F.col("max_value"))
    )


def ratio_recompute(df: DataFrame, keys: list[str], stored: str, recomputed: Column, tolerance: str) -> DataFrame:
    """Rows whose stored ratio is further than ``tolerance`` from the recomputed one."""
    again = df.select(*keys, F.col(stored).alias("stored"), recomputed.alias("recomputed"))
    return again.filter(F.abs(F.col("stored") - F.col("recomputed")) > F.lit(tolerance).cast("decimal(18,9)"))


def monotone_cumulative(df: DataFrame, part: str, order: str, column: str) -> DataFrame:
    """Rows whose running total is below the one before."""
    before = F.lag(column).over(W.partitionBy(part).orderBy(order))
    return df.select(part, order, F.col(column).alias("value"), before.alias("previous")).filter("value < previous")


def month0_invariants(core: DataFrame) -> DataFrame:
    """Cohort rows breaking a rule, with the name of the rule."""
    first = F.col("month_n") == 0
    rules = {
        "month_before_cohort": F.col("year_month") < F.col("cohort_year_month"),
        "month0_active_is_size": first & (F.col("cohort_active_buyers") != F.col("cohort_size")),
        "no_buyers_no_measures": (F.col("cohort_active_buyers") == 0)
        & ((F.col("cohort_order_cnt") != 0) | (F.col("cohort_gross_revenue") != 0)),
        "month0_cumulative_revenue": first & (F.col("cum_gross_revenue") != F.col("cohort_gross_revenue")),
        "month0_cumulative_orders": first & (F.col("cum_order_cnt") != F.col("cohort_order_cnt")),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return core.select("cohort_year_month", "year_month", "month_n", F.explode(broken).alias("rule_name"))


def last_cumulative_equals_total(
    df: DataFrame, key: str, order: str, cumulative: str, value: str, tolerance: str = "0.001"
) -> DataFrame:
    """Groups whose running total in the last row is not the sum of the group; one aggregation, no self-join."""
    return (
        df.groupBy(key)
        .agg(F.max_by(cumulative, order).alias("last_cumulative"), F.sum(value).alias("total"))
        .filter(F.abs(F.col("last_cumulative") - F.col("total")) > F.lit(tolerance).cast("decimal(18,9)"))
    )


def calendar_boundary_checks(dim_date: DataFrame) -> DataFrame:
    """Days around every turn of the year with their ISO week and weekday number."""
    turn = ((F.col("month") == 12) & (F.col("day") >= 25)) | ((F.col("month") == 1) & (F.col("day") <= 10))
    return dim_date.filter(turn | ~F.col("day_of_week").between(1, 7)).select(
        "date", "week_of_year", "day_of_week", "day_name"
    )
