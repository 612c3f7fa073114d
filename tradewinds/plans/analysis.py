"""Star schema -> monthly KPIs and cohorts.

Person-month rows are the common base. They are unique per (person, month) by construction, so
every later 'distinct buyers' is a plain count, and everything after them has at most one row
per pair of calendar months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.functions import month_index, month_label_of_index, month_offset, safe_ratio, to_flag
from tradewinds.functions.ratios import MONEY_TYPE
from tradewinds.operators.aggregates import conditional_distinct, pivot_months
from tradewinds.operators.calendar import dense_months, fill_months
from tradewinds.operators.joins import lookup_join
from tradewinds.plans.marts import with_month
from tradewinds.sources.schemas import columns_of

PERSON_MONTH = ("customer_unique_id", "year_month")


def _zero_money() -> Column:
    return F.lit(0).cast(MONEY_TYPE)


# --- person-month base ----------------------------------------------------------------------


def base_orders(delivered_orders: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """Distinct delivered orders per person and month."""
    ids = dim_customer.select("customer_id", "customer_unique_id")
    owned = lookup_join(delivered_orders.select("order_id", "customer_id", "year_month"), ids, "customer_id")
    return conditional_distinct(owned, PERSON_MONTH, "order_id", {"order_cnt": None})


def base_items(delivered_items: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """Items and revenue per person and month; items collapse per customer and month before the lookup."""
    per_customer = delivered_items.groupBy("customer_id", "year_month").agg(
        F.count(F.lit(1)).alias("item_cnt"), F.sum("item_total_value").alias("revenue")
    )
    ids = dim_customer.select("customer_id", "customer_unique_id")
    return (
        lookup_join(per_customer, ids, "customer_id")
        .groupBy(*PERSON_MONTH)
        .agg(F.sum("item_cnt").alias("item_cnt"), F.sum("revenue").cast(MONEY_TYPE).alias("gross_revenue"))
    )


def new_repeat_flags(month: str = "year_month", cohort: str = "cohort_year_month") -> list[Column]:
    return [
        to_flag(F.col("order_cnt") > 0).alias("is_active"),
        to_flag(F.col(month) == F.col(cohort)).alias("is_new_buyer"),
        to_flag(F.col(month) > F.col(cohort)).alias("is_repeat_buyer"),
    ]


def person_months(delivered_orders: DataFrame, items: DataFrame, dim_customer: DataFrame, colocated: bool = False) -> DataFrame:
    """Orders, items and revenue per person and month; a month depends on the orders and items of that month alone.

    ``items`` is the item fact, of which only items of delivered orders come through. The totals are those of
    the view of delivered items: an order row that occurs twice brings its items twice, but counts as one order.

    Built as one flow: items collapse per order and meet the orders on the order key, which also serves the grouping per
    order; then the totals collapse to (person, month). ``colocated``: orders and items are stored in equal buckets by
    order, so they meet before anything moves the orders.
    """
    per_order = items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_cnt"), F.sum("item_total_value").alias("revenue")
    )
    ids = dim_customer.select("customer_id", "customer_unique_id")
    placed = delivered_orders.select("order_id", "customer_id", "year_month")
    if colocated:
        owned = lookup_join(placed.join(per_order, "order_id", "left"), ids, "customer_id")
    else:
        owned = lookup_join(placed, ids, "customer_id").join(per_order, "order_id", "left")
    # rows with the same order id meet here once more, so a repeated order row counts as one order
    orders = owned.groupBy(*PERSON_MONTH, "order_id").agg(F.sum("item_cnt").alias("item_cnt"), F.sum("revenue").alias("revenue"))
    return orders.groupBy(*PERSON_MONTH).agg(
        F.count(F.lit(1)).alias("order_cnt"),
        F.coalesce(F.sum("item_cnt"), F.lit(0)).alias("item_cnt"),
        F.coalesce(F.sum("revenue").cast(MONEY_TYPE), _zero_money()).alias("gross_revenue"),
    )


def with_cohorts(person_month: DataFrame) -> DataFrame:
    """The sparse person-month table: cohort month, months since, and flags beside the totals of ``person_months``.

    The cohort month is the earliest month of the person. The window runs over a person's months, never over raw rows.
    """
    months_of_person = W.partitionBy("customer_unique_id")
    return person_month.withColumn("cohort_year_month", F.min("year_month").over(months_of_person)).select(
        *PERSON_MONTH,
        "cohort_year_month",
        month_offset("cohort_year_month", "year_month").alias("month_n"),
        "order_cnt",
        "item_cnt",
        "gross_revenue",
        *new_repeat_flags(),
    )


def base_customer_monthly_purchase(
    delivered_orders: DataFrame, items: DataFrame, dim_customer: DataFrame, colocated: bool = False
) -> DataFrame:
    """Sparse person-month table with cohort month, order, item and revenue totals."""
    return with_cohorts(person_months(delivered_orders, items, dim_customer, colocated))


def dense_customer_month(base: DataFrame, last_month: Column) -> DataFrame:
    """Person x month grid from the cohort month to ``last_month``; inactive months are 0-filled."""
    empty = {"order_cnt": F.lit(0), "item_cnt": F.lit(0), "gross_revenue": _zero_money()}
    return fill_months(base, "customer_unique_id", "cohort_year_month", last_month, empty, active="is_active")


# --- monthly KPIs -----------------------------------------------------------------------------


def kpi_monthly_core(dim_date: DataFrame, base: DataFrame) -> DataFrame:
    """Every calendar month: revenue, orders, buyers, average order value, repeat buyers and their rate."""
    monthly = base.groupBy("year_month").agg(
        F.sum("gross_revenue").cast(MONEY_TYPE).alias("gross_revenue"),
        F.sum("order_cnt").alias("order_cnt"),
        F.count(F.lit(1)).alias("active_buyers"),
        F.sum("is_repeat_buyer").alias("repeat_buyers"),
    )
    return dense_months(dim_date).join(monthly, "year_month", "left").select(
        "year_month",
        F.coalesce("gross_revenue", _zero_money()).alias("gross_revenue"),
        F.coalesce("order_cnt", F.lit(0)).alias("order_cnt"),
        F.coalesce("active_buyers", F.lit(0)).alias("active_buyers"),
        safe_ratio(F.col("gross_revenue"), F.col("order_cnt"), MONEY_TYPE, MONEY_TYPE).alias("aov"),
        F.coalesce("repeat_buyers", F.lit(0)).alias("repeat_buyers"),
        safe_ratio(F.col("repeat_buyers"), F.col("active_buyers")).alias("repeat_buyer_rate"),
    )


def cancellation_conditions() -> dict[str, Column | None]:
    status = F.col("order_status")
    return {
        "total_orders": None,
        "canceled_orders": status == "canceled",
        "unavailable_orders": status == "unavailable",
        "failed_orders": status.isin("canceled", "unavailable"),
    }


def cancellation_rates() -> list[Column]:
    total = F.col("total_orders")
    return [
        safe_ratio(F.col("canceled_orders"), total).alias("cancel_rate"),
        safe_ratio(F.col("unavailable_orders"), total).alias("unavailable_rate"),
        safe_ratio(F.col("failed_orders"), total).alias("failed_rate"),
    ]


def kpi_monthly_cancellation(fact_orders: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Every calendar month over all orders: totals, canceled, unavailable, failed, and their rates."""
    dated = with_month(fact_orders.select("order_id", "order_status", "order_purchase_date_key"), "order_purchase_date_key")
    counts = conditional_distinct(dated, ["year_month"], "order_id", cancellation_conditions())
    names = list(cancellation_conditions())
    return dense_months(dim_date).join(counts, "year_month", "left").select(
        "year_month", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], *cancellation_rates()
    )


# --- cohorts ------------------------------------------------------------------------------------


def cohort_base_agg(base: DataFrame) -> DataFrame:
    """Per cohort and month: buyers, orders, revenue (only months with purchases)."""
    return base.groupBy("cohort_year_month", "year_month", "month_n").agg(
        F.count(F.lit(1)).alias("cohort_active_buyers"),
        F.sum("order_cnt").alias("cohort_order_cnt"),
        F.sum("gross_revenue").cast(MONEY_TYPE).alias("cohort_gross_revenue"),
    )


def cohort_size(base: DataFrame) -> DataFrame:
    """Buyers of each cohort in its first month."""
    return base.filter("month_n = 0").groupBy("cohort_year_month").agg(F.count(F.lit(1)).alias("cohort_size"))


def last_calendar_month(dim_date: DataFrame) -> Column:
    """The latest month label of the calendar as a scalar subquery."""
    return dim_date.agg(F.max("year_month")).scalar()


def cohort_matrix(cohorts: DataFrame, last_month: Column) -> DataFrame:
    """Cohort x month grid from the cohort month to the end of the calendar, generated per cohort."""
    first, last = month_index("cohort_year_month"), month_index(last_month)
    return (
        cohorts.select("cohort_year_month")
        .distinct()
        .filter(first <= last)
        .select("cohort_year_month", F.posexplode(F.sequence(first, last)).alias("month_n", "m"))
        .select("cohort_year_month", month_label_of_index("m").alias("year_month"), "month_n")
    )


def cohort_monthly_core(dim_date: DataFrame, base: DataFrame) -> DataFrame:
    """Dense cohort x month table with retention, average order value and running totals.

    The person-month rows are read once: a cohort's first month is always observed, so grid
    and size follow from the cohort-month aggregate (at most one row per pair of calendar months).
    """
    empty = {"cohort_active_buyers": F.lit(0), "cohort_order_cnt": F.lit(0), "cohort_gross_revenue": _zero_money()}
    filled = fill_months(
        cohort_base_agg(base), "cohort_year_month", "cohort_year_month", last_calendar_month(dim_date), empty
    )
    first_buyers = F.max(F.when(F.col("month_n") == 0, F.col("cohort_active_buyers")))
    sized = filled.withColumn("cohort_size", first_buyers.over(W.partitionBy("cohort_year_month")))
    return sized.select("*", *cohort_retention_aov(), *cohort_cumulative()).select(columns_of("cohort_monthly_core"))


def cohort_retention_aov() -> list[Column]:
    return [
        safe_ratio(F.col("cohort_active_buyers"), F.col("cohort_size")).alias("cohort_retention_rate"),
        safe_ratio(F.col("cohort_gross_revenue"), F.col("cohort_order_cnt"), MONEY_TYPE, MONEY_TYPE).alias("cohort_aov"),
    ]


def cohort_cumulative() -> list[Column]:
    """Running totals over the months of a cohort (a partition is as long as the calendar)."""
    so_far = W.partitionBy("cohort_year_month").orderBy("month_n").rowsBetween(W.unboundedPreceding, 0)
    return [
        F.sum("cohort_gross_revenue").over(so_far).cast(MONEY_TYPE).alias("cum_gross_revenue"),
        F.sum("cohort_order_cnt").over(so_far).alias("cum_order_cnt"),
    ]


def cohort_pivot(core: DataFrame, measure: str, months: int = 12) -> DataFrame:
    """Cohort rows, month columns. measure: buyers, orders, revenue, retention or aov.

    Missing months are NULL for buyers, retention and aov, and 0 for orders and revenue.
    """
    value, how, fill = {
        "buyers": ("cohort_active_buyers", "sum", None),
        "orders": ("cohort_order_cnt", "sum", 0),
        "revenue": ("cohort_gross_revenue", "sum", 0),
        "retention": ("cohort_retention_rate", "max", None),
        "aov": ("cohort_aov", "max", None),
    }[measure]
    size = F.max("cohort_size").alias("cohort_size")
    return pivot_months(core, "cohort_year_month", value, measure, months, [size], fill, how)
