"""KPIs the documents define on top of the star schema and the monthly views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.functions import safe_ratio, to_flag
from tradewinds.functions.ratios import MONEY_TYPE
from tradewinds.operators.aggregates import conditional_distinct
from tradewinds.operators.joins import lookup_join
from tradewinds.plans.analysis import cancellation_conditions, cancellation_rates


def _mean(total: str, count: str, result_type: str = MONEY_TYPE) -> Column:
    return safe_ratio(F.col(total), F.col(count), result_type, MONEY_TYPE)


def kpi_sales_summary(items: DataFrame, period: str | None = None) -> DataFrame:
    """Revenue, items, distinct orders, mean item total and mean freight, overall or per ``period`` column.

    Items collapse per order first, so distinct orders are a count of the collapsed rows.
    """
    group = [] if period is None else [period]
    per_order = items.groupBy(*group, "order_id").agg(
        F.sum("item_total_value").alias("revenue"),
        F.count("item_total_value").alias("valued"),
        F.sum("freight_value").alias("freight"),
        F.count("freight_value").alias("freighted"),
        F.count(F.lit(1)).alias("items"),
    )
    totals = per_order.groupBy(*group).agg(
        F.sum("revenue").cast(MONEY_TYPE).alias("gross_revenue"),
        F.sum("items").alias("item_cnt"),
        F.count("order_id").alias("order_cnt"),
        F.sum("valued").alias("valued"),
        F.sum("freight").cast(MONEY_TYPE).alias("freight"),
        F.sum("freighted").alias("freighted"),
    )
    return totals.select(
        *group,
        "gross_revenue",
        "item_cnt",
        "order_cnt",
        _mean("gross_revenue", "valued").alias("avg_item_total"),
        _mean("freight", "freighted").alias("avg_freight"),
    )


def _revenue_by(items: DataFrame, item_key: str, names: DataFrame, label: str) -> DataFrame:
    """Revenue per label: items collapse to one row per key, the keys are looked up, labels are summed."""
    per_key = items.groupBy(item_key).agg(
        F.sum("item_total_value").alias("revenue"), F.count(F.lit(1)).alias("item_cnt")
    )
    return (
        lookup_join(per_key, names, item_key, "left")
        .groupBy(label)
        .agg(F.sum("revenue").cast(MONEY_TYPE).alias("gross_revenue"), F.sum("item_cnt").alias("item_cnt"))
    )


def revenue_by_category(items: DataFrame, dim_product: DataFrame) -> DataFrame:
    names = dim_product.select("product_id", "product_category_name")
    return _revenue_by(items, "product_id", names, "product_category_name")


def revenue_by_region(items: DataFrame, dim_geolocation: DataFrame, side: str = "customer") -> DataFrame:
    """Revenue per city_state of the customer or the seller; zips without coverage stay as a NULL region."""
    zip_col = f"{side}_zip_code_prefix"
    names = dim_geolocation.select(
        F.col("geolocation_zip_code_prefix").alias(zip_col), F.col("geolocation_city_state").alias("city_state")
    )
    return _revenue_by(items, zip_col, names, "city_state")


def kpi_operations_summary(fact_orders: DataFrame, period: str | None = None) -> DataFrame:
    """Orders, cancel and completion rates, mean lead times, share of late deliveries."""
    group = [] if period is None else [period]
    totals = fact_orders.groupBy(*group).agg(
        F.count(F.lit(1)).alias("order_cnt"),
        F.sum("is_canceled").alias("canceled"),
        F.sum("is_delivered").alias("delivered"),
        F.sum("approve_lead_days").alias("approve_days"),
        F.count("approve_lead_days").alias("approved"),
        F.sum("delivery_lead_days").alias("delivery_days"),
        F.count("delivery_lead_days").alias("timed"),
        F.count_if(F.col("delivery_delay_days") > 0).alias("late"),
    )
    orders = F.col("order_cnt")
    return totals.select(
        *group,
        "order_cnt",
        safe_ratio(F.col("canceled"), orders).alias("cancel_rate"),
        safe_ratio(F.col("delivered"), orders).alias("completion_rate"),
        _mean("approve_days", "approved").alias("avg_approve_lead_days"),
        _mean("delivery_days", "timed").alias("avg_delivery_lead_days"),
        safe_ratio(F.col("late"), orders).alias("late_rate"),
    )


def overall_repeat_rate(base: DataFrame) -> DataFrame:
    """Buyers with two or more delivered orders over all buyers, whole period."""
    people = base.groupBy("customer_unique_id").agg(F.sum("order_cnt").alias("orders"))
    return people.agg(
        F.count(F.lit(1)).alias("buyers"), F.count_if(F.col("orders") >= 2).alias("repeat_buyers")
    ).select("*", safe_ratio(F.col("repeat_buyers"), F.col("buyers")).alias("repeat_rate"))


PERIODS = {"month": 12, "quarter": 4, "year": 1}


def revenue_trend(core: DataFrame, grain: str = "month") -> DataFrame:
    """Revenue per month, quarter or year with growth on the period before and on the same period a year ago.

    Works on the dense monthly KPIs: the window runs over calendar periods only.
    """
    per_year = PERIODS[grain]
    year, month = F.substring("year_month", 1, 4), F.substring("year_month", 6, 2).cast("int")
    label = {
        "month": F.col("year_month"),
        "quarter": F.concat(year, F.lit("-Q"), F.ceil(month / 3).cast("string")),
        "year": year,
    }[grain]
    totals = core.groupBy(label.alias("period")).agg(F.sum("gross_revenue").cast(MONEY_TYPE).alias("gross_revenue"))
    in_time = W.orderBy("period")

    def growth(steps: int) -> Column:
        before = F.lag("gross_revenue", steps).over(in_time)
        change = (F.col("gross_revenue") - before).cast(MONEY_TYPE)
        return (change / F.nullif(before, F.lit(0).cast(MONEY_TYPE))).cast("decimal(18,6)")

    return totals.select(
        "period", "gross_revenue", growth(1).alias("growth_vs_previous"), growth(per_year).alias("growth_vs_last_year")
    )


def cancellation_breakdown(labelled_orders: DataFrame, label: str) -> DataFrame:
    """Cancellation counts and rates per ``label`` of a frame with order_id and order_status.

    An order with several labels counts once under each.
    """
    counts = conditional_distinct(labelled_orders, [label], "order_id", cancellation_conditions())
    return counts.select("*", *cancellation_rates())


def orders_by_category(fact_orders: DataFrame, fact_order_items: DataFrame, dim_product: DataFrame) -> DataFrame:
    pairs = fact_order_items.select("order_id", "product_id").distinct()
    named = lookup_join(pairs, dim_product.select("product_id", "product_category_name"), "product_id", "left")
    labels = named.select("order_id", "product_category_name").distinct()
    return lookup_join(labels, fact_orders.select("order_id", "order_status"), "order_id")


def orders_by_seller(fact_orders: DataFrame, fact_order_items: DataFrame) -> DataFrame:
    pairs = fact_order_items.select("order_id", "seller_id").distinct()
    return lookup_join(pairs, fact_orders.select("order_id", "order_status"), "order_id")


def orders_by_region(fact_orders: DataFrame, dim_geolocation: DataFrame) -> DataFrame:
    names = dim_geolocation.select(
        F.col("geolocation_zip_code_prefix").alias("customer_zip_code_prefix"),
        F.col("geolocation_city_state").alias("city_state"),
    )
    orders = fact_orders.select("order_id", "order_status", "customer_zip_code_prefix")
    return lookup_join(orders, names, "customer_zip_code_prefix", "left")


def join_integrity_flags(
    stg_orders: DataFrame, stg_order_items: DataFrame, stg_order_payments: DataFrame, stg_order_reviews: DataFrame
) -> DataFrame:
    """Per order: no items, no payments, a review written before the purchase."""
    items = stg_order_items.groupBy("order_id").agg(F.lit(1).alias("has_items"))
    payments = stg_order_payments.groupBy("order_id").agg(F.lit(1).alias("has_payments"))
    reviews = stg_order_reviews.groupBy("order_id").agg(F.min("review_creation_dt").alias("first_review"))
    orders = stg_orders.select("order_id", "order_purchase_dt")
    return (
        orders.join(items, "order_id", "left")
        .join(payments, "order_id", "left")
        .join(reviews, "order_id", "left")
        .select(
            "order_id",
            to_flag(F.col("has_items").isNull()).alias("is_without_items"),
            to_flag(F.col("has_payments").isNull()).alias("is_without_payments"),
            to_flag(F.col("first_review") < F.col("order_purchase_dt")).alias("is_reviewed_before_purchase"),
        )
    )


def orders_vs_aov_decomposition(core: DataFrame) -> DataFrame:
    """Month-on-month revenue change split into an order-count part and an order-value part.

    order_effect = (orders - previous orders) * previous revenue / previous orders; the rest
    of the change is the order-value part. Both are NULL when there is no previous month with orders.
    """
    in_time = W.orderBy("year_month")
    revenue0, orders0 = F.lag("gross_revenue").over(in_time), F.lag("order_cnt").over(in_time)
    framed = core.select(
        "year_month", "gross_revenue", "order_cnt", revenue0.alias("revenue0"), orders0.alias("orders0")
    )
    change = (F.col("gross_revenue") - F.col("revenue0")).cast(MONEY_TYPE)
    more_orders = (F.col("order_cnt") - F.col("orders0")).cast("decimal(12,0)")
    effect = safe_ratio(more_orders * F.col("revenue0"), F.col("orders0"), MONEY_TYPE, "decimal(30,2)")
    return framed.select(
        "year_month",
        change.alias("revenue_change"),
        effect.alias("order_effect"),
        (change - effect).cast(MONEY_TYPE).alias("aov_effect"),
    )
