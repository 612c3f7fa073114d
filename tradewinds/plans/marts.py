"""Staging -> star schema: five dimensions, two facts, three delivered-order views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewinds.functions import date_key, month_label_of_key
from tradewinds.operators.calendar import calendar_table, date_bounds, generate_calendar
from tradewinds.operators.joins import lookup_join
from tradewinds.sources.schemas import columns_of

HeavyKeys = Mapping[str, Sequence[tuple[object, int]]]
NONE_HEAVY: HeavyKeys = {}

ORDER_DATES = (
    "order_purchase_dt",
    "order_approved_dt",
    "order_delivered_carrier_dt",
    "order_delivered_customer_dt",
    "order_estimated_delivery_dt",
)


def dim_date(stg_orders: DataFrame) -> DataFrame:
    """One row per day over every order date, widened by a month on both ends. One pass over the orders."""
    return calendar_table(generate_calendar(date_bounds(stg_orders, ORDER_DATES)))


def month_bounds(fact_orders: DataFrame) -> DataFrame:
    """(year_month, low, high): the earliest and latest of all dates of a month's orders."""
    dates = [F.col(c).cast("date") for c in ORDER_DATES]
    low, high = F.least(*[F.min(d) for d in dates]), F.greatest(*[F.max(d) for d in dates])
    return with_month(fact_orders, "order_purchase_date_key").groupBy("year_month").agg(low.alias("low"), high.alias("high"))


def dim_date_over(bounds: DataFrame) -> DataFrame:
    """The calendar of ``dim_date`` from the bounds of all months of orders."""
    ends = bounds.agg(F.add_months(F.min("low"), -1).alias("start_date"), F.add_months(F.max("high"), 1).alias("end_date"))
    return calendar_table(generate_calendar(ends))


def dim_geolocation(stg_geolocation: DataFrame) -> DataFrame:
    return stg_geolocation.select(columns_of("dim_geolocation"))


def dim_customer(stg_customers: DataFrame) -> DataFrame:
    return stg_customers.select(columns_of("dim_customer"))


def dim_product(stg_products: DataFrame) -> DataFrame:
    return stg_products.select(columns_of("dim_product"))


def dim_seller(stg_sellers: DataFrame) -> DataFrame:
    return stg_sellers.select(columns_of("dim_seller"))


def fact_orders(stg_orders: DataFrame, stg_customers: DataFrame, heavy: HeavyKeys = NONE_HEAVY) -> DataFrame:
    """Grain: order. Adds the customer's zip (NULL when unknown) and the integer date key."""
    zips = stg_customers.select("customer_id", "customer_zip_code_prefix")
    keyed = stg_orders.withColumn("order_purchase_date_key", date_key("order_purchase_dt"))
    return lookup_join(keyed, zips, "customer_id", "left", heavy.get("customer_id", ())).select(columns_of("fact_orders"))


def fact_order_items(
    stg_order_items: DataFrame,
    stg_orders: DataFrame,
    stg_customers: DataFrame,
    stg_sellers: DataFrame,
    heavy: HeavyKeys = NONE_HEAVY,
    by_order: bool = False,
) -> DataFrame:
    """Grain: (order, item). Items without an order drop out; unknown customers or sellers leave NULL zips.

    The customer's zip is attached to the orders first, which are fewer than the items. ``heavy``: keys that hold a large
    share of the rows, by column, as stored beside the staging tables. ``by_order``: the items are grouped by order next,
    so they are dealt by it.
    """
    orders = stg_orders.select(
        "order_id", "customer_id", date_key("order_purchase_date").alias("order_purchase_date_key")
    )
    customer_zips = stg_customers.select("customer_id", "customer_zip_code_prefix")
    seller_zips = stg_sellers.select("seller_id", "seller_zip_code_prefix")
    located = lookup_join(orders, customer_zips, "customer_id", "left", heavy.get("customer_id", ()))
    items = lookup_join(stg_order_items, located, "order_id", "inner", heavy.get("order_id", ()), deal=by_order)
    return lookup_join(items, seller_zips, "seller_id", "left", heavy.get("seller_id", ())).select(columns_of("fact_order_items"))


def with_month(df: DataFrame, key: str, dim_date: DataFrame | None = None, name: str = "year_month") -> DataFrame:
    """Add the month label of a date key.

    A table stored by month brings the label along. Else the calendar spans every order date by construction, so the label can be read off the key
    without touching the calendar. Given a ``dim_date`` of another origin, rows on days it
    lacks are dropped.
    """
    if dim_date is None and name in df.columns:
        return df
    if dim_date is None:
        return df.withColumn(name, month_label_of_key(key))
    days = dim_date.select(F.col("date_key").alias(key), F.col("year_month").alias(name))
    return lookup_join(df.drop(name), days, key)


def vw_delivered_orders(fact_orders: DataFrame, dim_date: DataFrame | None = None) -> DataFrame:
    """Orders with status 'delivered' and a delivery time, with their month label."""
    delivered = fact_orders.filter((F.col("order_status") == "delivered") & (F.col("is_delivered") == 1))
    return with_month(delivered, "order_purchase_date_key", dim_date).select(
        "order_id",
        "customer_id",
        "customer_zip_code_prefix",
        "order_purchase_date_key",
        "year_month",
        "order_status",
        "is_delivered",
        "is_canceled",
        "order_purchase_dt",
        "order_approved_dt",
        "order_delivered_carrier_dt",
        "order_delivered_customer_dt",
        "order_estimated_delivery_dt",
        "approve_lead_days",
        "delivery_lead_days",
        "delivery_delay_days",
    )


def vw_delivered_order_items(
    fact_order_items: DataFrame, delivered_orders: DataFrame, heavy: Sequence[tuple[object, int]] = ()
) -> DataFrame:
    """Items of delivered orders; customer and month come from the order.

    Where the items bring their month along, which is that of their order, it is part of the join, so a filter on months
    reads those months of both facts only.
    """
    orders = delivered_orders.select(
        "order_id", "customer_id", "customer_zip_code_prefix", "order_purchase_date_key", "year_month"
    )
    items = fact_order_items.drop("customer_id", "customer_zip_code_prefix", "order_purchase_date_key")
    also = [c for c in ("year_month",) if c in items.columns]
    return lookup_join(items, orders, "order_id", "inner", heavy, also).select(
        "order_id",
        "order_item_id",
        "order_item_seq",
        "customer_id",
        "customer_zip_code_prefix",
        "product_id",
        "seller_id",
        "seller_zip_code_prefix",
        "order_purchase_date_key",
        "year_month",
        "price",
        "freight_value",
        "item_total_value",
    )


def vw_customer_first_purchase_month(
    delivered_orders: DataFrame, dim_customer: DataFrame, dim_date: DataFrame | None = None
) -> DataFrame:
    """Earliest delivered purchase of each person. Orders collapse per customer before the identity lookup."""
    first = delivered_orders.groupBy("customer_id").agg(F.min("order_purchase_date_key").alias("first_key"))
    people = lookup_join(first, dim_customer.select("customer_id", "customer_unique_id"), "customer_id")
    earliest = people.groupBy("customer_unique_id").agg(F.min("first_key").alias("first_purchase_date_key"))
    return with_month(earliest, "first_purchase_date_key", dim_date, "first_purchase_year_month").select(
        "customer_unique_id", "first_purchase_date_key", "first_purchase_year_month"
    )


def cohort_order_history(
    first_purchase: DataFrame, delivered_orders: DataFrame, dim_customer: DataFrame, cohorts: list[str]
) -> DataFrame:
    """All delivered orders of the people whose first purchase fell in one of ``cohorts``."""
    people = first_purchase.filter(F.col("first_purchase_year_month").isin(*cohorts)).select("customer_unique_id")
    ids = lookup_join(dim_customer.select("customer_id", "customer_unique_id"), people, "customer_unique_id")
    return lookup_join(delivered_orders, ids, "customer_id").select(
        "customer_unique_id",
        "order_id",
        "order_purchase_date_key",
        "year_month",
        "order_purchase_dt",
        "order_delivered_customer_dt",
    )
