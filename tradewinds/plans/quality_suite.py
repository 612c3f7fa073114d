"""The rules of the quality suite: which references hold between tables, and the report over all rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewinds.operators import quality as qc
from tradewinds.operators.quality.keys import union_all
from tradewinds.plans.counters import CRITICAL_COLUMNS, FLAG_TABLES, PRIMARY_KEYS, ROWS, VALUE_TYPE, domain_rules, kept_counters, table_counters
from tradewinds.plans.warehouse import Warehouse

# The names of these rules and of the domain rules below are those that users of the report look up.
# rule -> (child table, child key, parent table, parent key)
REFERENCES: dict[str, tuple[str, str, str, str]] = {
    "orders.customer_id -> customers": ("stg_orders", "customer_id", "stg_customers", "customer_id"),
    "order_items.order_id -> orders": ("stg_order_items", "order_id", "stg_orders", "order_id"),
    "order_items.product_id -> products": ("stg_order_items", "product_id", "stg_products", "product_id"),
    "order_items.seller_id -> sellers": ("stg_order_items", "seller_id", "stg_sellers", "seller_id"),
    "order_payments.order_id -> orders": ("stg_order_payments", "order_id", "stg_orders", "order_id"),
    "order_reviews.order_id -> orders": ("stg_order_reviews", "order_id", "stg_orders", "order_id"),
    "customers.zip -> geolocation": (
        "stg_customers",
        "customer_zip_code_prefix",
        "stg_geolocation",
        "geolocation_zip_code_prefix",
    ),
    "sellers.zip -> geolocation": (
        "stg_sellers",
        "seller_zip_code_prefix",
        "stg_geolocation",
        "geolocation_zip_code_prefix",
    ),
}
# Coverage of the source is watched, not failed.
MONITORED_RULES = {"customers.zip -> geolocation", "sellers.zip -> geolocation"}


def pk_specs(w: Warehouse) -> dict[str, tuple[DataFrame, list[str]]]:
    return {name: (w.table(name), keys) for name, keys in PRIMARY_KEYS.items()}


def pk_uniqueness(w: Warehouse) -> DataFrame:
    return qc.pk_uniqueness_summary(pk_specs(w))


def pk_nulls(w: Warehouse) -> DataFrame:
    return qc.pk_null_summary(pk_specs(w))


def critical_nulls(w: Warehouse) -> DataFrame:
    return qc.critical_null_summary({t: (w.table(t), *columns) for t, columns in CRITICAL_COLUMNS.items()})


def flags(w: Warehouse) -> DataFrame:
    return qc.flag_snapshot({t: w.table(t) for t in FLAG_TABLES})


def domains(w: Warehouse) -> DataFrame:
    return qc.domain_range_rules({t: (w.table(t), rules) for t, rules in domain_rules().items()})


def references(w: Warehouse) -> DataFrame:
    return qc.referential_summary(
        {rule: (child, w.table(child), ck, w.table(parent), pk) for rule, (child, ck, parent, pk) in REFERENCES.items()}
    )


RAW_OF = {
    "stg_orders": "orders",
    "stg_customers": "customers",
    "stg_order_items": "order_items",
    "stg_products": "products",
    "stg_sellers": "sellers",
    "stg_order_payments": "order_payments",
    "stg_order_reviews": "order_reviews",
}


def row_counts(w: Warehouse) -> DataFrame:
    """Raw against staging; the collapsed geolocation is compared with the distinct raw zips."""
    pairs = {raw: (w.raw(raw), _counted(w, stg)) for stg, raw in RAW_OF.items()}
    zips = w.raw("geolocation").select(F.trim("geolocation_zip_code_prefix").alias("zip")).distinct()
    pairs["geolocation_zips"] = (zips, _counted(w, "stg_geolocation"))
    return qc.row_count_reconcile(pairs)


def _counted(w: Warehouse, table: str) -> DataFrame | int:
    """The table, or the number of its rows where that is known since it was written."""
    kept = w.metrics(table)
    return int(kept[ROWS]) if kept else w.table(table)


def _counters(w: Warehouse, table: str) -> DataFrame:
    df, kept = w.table(table), w.metrics(table)
    return kept_counters(df.sparkSession, table, df.columns, kept) if kept else table_counters(df, table)


def _as_checks(df: DataFrame, section: str, subject: Column, check: Column, value: str, severity: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        subject.alias("subject"),
        check.alias("check_name"),
        severity.alias("severity"),
        F.col(value).cast(VALUE_TYPE).alias("value"),
    )


def run_qc(w: Warehouse) -> DataFrame:
    """The consolidated report: one row per check with its value, severity and verdict.

    'fail' rows must be zero; 'monitor' rows are reported only. Each table is read once for all its counters, unless they
    were kept when it was written, once for its key, and once for all references together.
    """
    fail, monitor = F.lit("fail"), F.lit("monitor")
    table = F.col("table_name")
    watched = F.when(F.col("rule_name").isin(*MONITORED_RULES), monitor).otherwise(fail)
    repeated = F.concat(F.lit("repeated "), F.col("pk_cols"))
    parts = [
        _as_checks(row_counts(w), "row counts", F.col("entity"), F.lit("staging - raw"), "diff", monitor),
        _as_checks(pk_uniqueness(w), "keys", table, repeated, "dup_cnt", fail),
        *[_counters(w, name) for name in PRIMARY_KEYS],
        _as_checks(references(w), "references", table, F.col("rule_name"), "orphan_cnt", watched),
    ]
    report = union_all(parts)
    passed = (F.col("severity") == "monitor") | (F.col("value") == 0)
    return report.withColumn("passed", F.coalesce(passed, F.lit(False)))
