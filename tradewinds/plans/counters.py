"""Counters of staging tables that need no other rows: rows, missing keys, critical columns, flags, domains.

They are taken while a table is written and kept beside it, or in one pass over a table that is not stored.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewinds.functions import percent
from tradewinds.operators.aggregates import one_row_to_long
from tradewinds.operators.quality.keys import any_null, key_label, missing_values
from tradewinds.plans.staging import LAT_RANGE, LNG_RANGE

VALUE_TYPE = "decimal(20,2)"
ROWS = "rows"

PRIMARY_KEYS: dict[str, list[str]] = {
    "stg_orders": ["order_id"],
    "stg_customers": ["customer_id"],
    "stg_order_items": ["order_id", "order_item_id"],
    "stg_products": ["product_id"],
    "stg_sellers": ["seller_id"],
    "stg_order_payments": ["order_id", "payment_sequential"],
    "stg_order_reviews": ["review_id", "order_id"],
    "stg_geolocation": ["geolocation_zip_code_prefix"],
}

# table -> (columns that must not be NULL, columns that must not be NULL or blank)
CRITICAL_COLUMNS: dict[str, tuple[list[str], list[str]]] = {
    "stg_orders": (["customer_id", "order_purchase_dt"], ["order_status"]),
    "stg_customers": (["customer_unique_id", "customer_zip_code_prefix"], ["customer_city_state"]),
    "stg_order_items": (["product_id", "seller_id", "price", "freight_value"], []),
    "stg_sellers": (["seller_zip_code_prefix"], ["seller_city_state"]),
    "stg_order_payments": (["payment_value"], ["payment_type"]),
    "stg_order_reviews": (["review_score"], []),
}

FLAG_TABLES = ["stg_orders", "stg_products", "stg_order_payments", "stg_order_reviews", "stg_geolocation"]

PAYMENT_TYPES = ["credit_card", "boleto", "voucher", "debit_card", "not_defined"]


def domain_rules() -> dict[str, dict[str, Column]]:
    """table -> rule -> condition that present values meet."""
    kind = F.col("payment_type")
    return {
        "stg_order_payments": {
            "payment_type_domain": (F.trim(kind) == "") | kind.isin(*PAYMENT_TYPES),
            "payment_sequential >= 1": F.col("payment_sequential") >= 1,
            "payment_installments >= 0": F.col("payment_installments") >= 0,
            "payment_value >= 0": F.col("payment_value") >= 0,
        },
        "stg_order_reviews": {"review_score BETWEEN 1 AND 5": F.col("review_score").between(1, 5)},
        "stg_order_items": {
            "price >= 0 AND freight_value >= 0": (F.coalesce("price", F.lit(0)) >= 0)
            & (F.coalesce("freight_value", F.lit(0)) >= 0)
        },
        "stg_geolocation": {
            "lat in range": F.col("geolocation_lat").between(*LAT_RANGE),
            "lng in range": F.col("geolocation_lng").between(*LNG_RANGE),
        },
    }


class Counter(NamedTuple):
    """A line of the report and the aggregate that is its value."""

    section: str
    check: str
    severity: str
    value: Column


def counters(table: str, columns: list[str]) -> list[Counter]:
    keys = PRIMARY_KEYS[table]
    out = [Counter("keys", f"missing {key_label(keys)}", "fail", F.count_if(any_null(keys)))]
    if table in CRITICAL_COLUMNS:
        null_cols, blank_cols = CRITICAL_COLUMNS[table]
        out.append(Counter("critical columns", ", ".join([*null_cols, *blank_cols]), "fail", missing_values(null_cols, blank_cols)))
    if table in FLAG_TABLES:
        flag_cols = [c for c in columns if c.startswith("is_")]
        out += [Counter("flags", c, "monitor", percent(F.count_if(F.col(c) == 1), F.count(F.lit(1)))) for c in flag_cols]
    return out + [Counter("domains", n, "fail", F.count_if(~ok)) for n, ok in domain_rules().get(table, {}).items()]


def metrics(table: str, columns: list[str]) -> dict[str, Column]:
    """What to observe while ``table`` is written; nothing for tables without counters."""
    if table not in PRIMARY_KEYS:
        return {}
    values = {str(i): c.value.cast(VALUE_TYPE) for i, c in enumerate(counters(table, columns))}
    return {ROWS: F.count(F.lit(1)), **values}


def table_counters(df: DataFrame, table: str) -> DataFrame:
    """(section, subject, check_name, severity, value) in one pass over ``df``."""
    rows = [
        {
            "section": F.lit(c.section),
            "subject": F.lit(table),
            "check_name": F.lit(c.check),
            "severity": F.lit(c.severity),
            "value": c.value.cast(VALUE_TYPE),
        }
        for c in counters(table, df.columns)
    ]
    return one_row_to_long(df, rows)


def kept_counters(spark: SparkSession, table: str, columns: list[str], kept: Mapping[str, str | None]) -> DataFrame:
    """As ``table_counters``, from the metrics kept beside the stored table."""
    rows = [
        (c.section, table, c.check, c.severity, None if kept[str(i)] is None else Decimal(kept[str(i)]))
        for i, c in enumerate(counters(table, columns))
    ]
    return spark.createDataFrame(rows, f"section string, subject string, check_name string, severity string, value {VALUE_TYPE}")
