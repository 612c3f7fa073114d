"""Row rules: counters, domains, flags, derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewinds.functions import percent
from tradewinds.operators.aggregates import one_row_to_long
from tradewinds.operators.quality.keys import union_all

KPI_TYPE = "decimal(20,6)"


def count_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule_name, violation_cnt): rows where each named condition is TRUE, in one pass."""
    return one_row_to_long(
        df, [{"rule_name": F.lit(n), "violation_cnt": F.count_if(c)} for n, c in rules.items()]
    )


def event_order_anomalies(df: DataFrame, base: str, columns: Sequence[str]) -> DataFrame:
    """Per time column: rows where it is earlier than ``base``."""
    return one_row_to_long(
        df, [{"column_name": F.lit(c), "early_cnt": F.count_if(F.col(c) < F.col(base))} for c in columns]
    )


def status_time_contradictions(parsed_orders: DataFrame) -> DataFrame:
    """Statuses that their own times contradict."""
    status = F.col("order_status")
    arrived = F.col("order_delivered_customer_dt").isNotNull()
    return count_violations(
        parsed_orders,
        {
            "delivered_without_delivery_time": (status == "delivered") & ~arrived,
            "failed_with_delivery_time": status.isin("canceled", "unavailable") & arrived,
            "approved_without_approval_time": (status == "approved") & F.col("order_approved_dt").isNull(),
            "in_transit_without_carrier_time": status.isin("shipped", "invoiced")
            & F.col("order_delivered_carrier_dt").isNull(),
        },
    )


def negative_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return one_row_to_long(
        df, [{"column_name": F.lit(c), "negative_cnt": F.count_if(F.col(c) < 0)} for c in columns]
    )


def geo_out_of_bounds(
    df: DataFrame, lat: str, lng: str, lat_range: tuple[int, int], lng_range: tuple[int, int]
) -> DataFrame:
    """Rows outside the box. An unknown coordinate alone does not make a row an outlier."""
    return df.filter(~F.col(lat).between(*lat_range) | ~F.col(lng).between(*lng_range))


def flag_snapshot(tables: Mapping[str, DataFrame], prefix: str = "is_") -> DataFrame:
    """Every flag column of every table: rows, NULLs, values other than 0/1, percent of ones."""
    parts = []
    for name, df in tables.items():
        flags = [c for c in df.columns if c.startswith(prefix)]
        if not flags:
            continue
        total = F.count(F.lit(1))
        rows = [
            {
                "table_name": F.lit(name),
                "flag_col": F.lit(c),
                "total_cnt": total,
                "null_cnt": F.count_if(F.col(c).isNull()),
                "invalid_value_cnt": F.count_if(~F.col(c).isin(0, 1)),
                "true_rate_pct": percent(F.count_if(F.col(c) == 1), total),
            }
            for c in flags
        ]
        parts.append(one_row_to_long(df, rows))
    return union_all(parts)


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return one_row_to_long(df, [{"flag_col": F.lit(c), "cnt": F.count_if(F.col(c) == 1)} for c in flags])


def domain_range_rules(rules: Mapping[str, tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """table -> (frame, rule name -> condition a present value must meet); an unknown value is not a violation."""
    return union_all(
        [
            one_row_to_long(
                df,
                [
                    {"table_name": F.lit(table), "rule_name": F.lit(n), "invalid_cnt": F.count_if(~ok)}
                    for n, ok in conditions.items()
                ],
            )
            for table, (df, conditions) in rules.items()
        ]
    )


def derived_consistency(
    df: DataFrame, column: str, formula: Column, inputs: Sequence[str], tolerance: str = "0.000001"
) -> DataFrame:
    """Derived column against its formula: missing although the inputs are there, present although not, different."""
    complete = F.lit(True)
    for c in inputs:
        complete = complete & F.col(c).isNotNull()
    gap = F.abs(F.col(column) - formula)
    return df.agg(
        F.count_if(complete & F.col(column).isNull()).alias("missing_cnt"),
        F.count_if(~complete & F.col(column).isNotNull()).alias("unexpected_cnt"),
        F.count_if(gap > F.lit(tolerance).cast("decimal(10,9)")).alias("mismatch_cnt"),
    )


def flag_rule_consistency(df: DataFrame, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """rule -> (0/1 column, condition): rows where the flag and the condition disagree."""
    return count_violations(
        df, {n: F.col(flag) != F.when(cond, 1).otherwise(0) for n, (flag, cond) in rules.items()}
    )


def kpi_range_report(df: DataFrame, kpis: Sequence[str]) -> DataFrame:
    """Long report: zero and negative counts, minimum and maximum of each KPI column, in one pass."""
    return one_row_to_long(
        df,
        [
            {
                "kpi": F.lit(k),
                "zero_cnt": F.count_if(F.col(k) == 0),
                "negative_cnt": F.count_if(F.col(k) < 0),
                "min_value": F.min(k).cast(KPI_TYPE),
                "max_value": F.max(k).cast(KPI_TYPE),
            }
            for k in kpis
        ],
    )


def buyer_flag_invariants(base: DataFrame) -> DataFrame:
    """Person-month rules; every count should be zero."""
    new, repeat = F.col("is_new_buyer") == 1, F.col("is_repeat_buyer") == 1
    return count_violations(
        base,
        {
            "new_and_repeat": new & repeat,
            "new_after_month_0": new & (F.col("month_n") != 0),
            "month_before_cohort": F.col("year_month") < F.col("cohort_year_month"),
            "orders_without_items_or_revenue": (F.col("order_cnt") > 0)
            & (F.col("item_cnt") == 0)
            & (F.col("gross_revenue") == 0),
        },
    )
