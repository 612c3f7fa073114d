"""Sources, sinks, staging, star schema, KPIs and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewinds import functions as fx
from tradewinds.operators.aggregates import ACCENT_FREE, conditional_distinct
from tradewinds.operators.calendar import date_bounds, dense_months, generate_calendar
from tradewinds.operators.quality.keys import union_all
from tradewinds.plans import analysis, kpis, marts, staging
from tradewinds.plans.warehouse import LAYERS
from tradewinds.registry.base import Context, query
from tradewinds.sources import driver_tables, sinks
from tradewinds.sources.csv import Loaded, blank_numeric_to_null, load_checked, load_raw_table, write_csv_table

# --- sources: the table goes out as CSV files and comes back through the loader -----------------


def _scratch(c: Context, name: str) -> str:
    return sinks.scratch_folder(c.spark, name)


def _csv_round_trip(name: str):
    def build(c: Context) -> DataFrame:
        path = _scratch(c, name)
        write_csv_table(c.raw(name), path)
        return load_raw_table(c.spark, name, path)

    return build


for _name in driver_tables.ADAPTERS:
    query(f"raw_{_name}")(_csv_round_trip(_name))


# columns of the tables that go out with damaged records, and the number by which records are chosen
_DAMAGED = {"order_reviews": "order_id", "sellers": "seller_id"}


def _damaged(c: Context, name: str) -> Loaded:
    """The table as lines of text, some with a field too few or too many, loaded with its rejects."""
    rows = c.raw(name)
    fields = F.array(*[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for f in rows.columns])
    rule = F.col(_DAMAGED[name]).cast("long") % 13
    damaged = F.when(rule == 1, F.slice(fields, 1, len(rows.columns) - 1)).when(rule == 2, F.array_append(fields, F.lit("more")))
    path = _scratch(c, f"lines-{name}")
    rows.select(F.array_join(F.coalesce(damaged, fields), ",").alias("value")).write.text(path)
    return load_checked(c.spark, name, path, header=False)


@query("raw_rejects")
def _raw_rejects(c: Context) -> DataFrame:
    found = union_all([_damaged(c, name).rejects for name in _DAMAGED])
    return found.select("table_name", "n_fields", "reason", "record", (F.col("position") > 0).alias("has_position"))


@query("raw_accepted")
def _raw_accepted(c: Context) -> DataFrame:
    return _damaged(c, "order_reviews").rows


@query("blank_numeric_to_null")
def _blank_numeric_to_null(c: Context) -> DataFrame:
    price = F.col("price").cast("string")
    as_text = c.raw("order_items").select(
        "order_id",
        "order_item_id",
        F.when(F.col("product_id").endswith("7"), " ").when(F.col("product_id").endswith("3"), "n/a").otherwise(price).alias("price"),
        F.when(F.col("seller_id").endswith("9"), "")
        .otherwise(F.concat(F.lit(" "), F.col("order_item_id"), F.lit(" ")))
        .alias("line_no"),
    )
    return blank_numeric_to_null(as_text, {"price": T.DecimalType(10, 2), "line_no": T.IntegerType()})


@query("overwrite_table")
def _overwrite_table(c: Context) -> DataFrame:
    return sinks.overwrite_table(c.stg_order_payments, _scratch(c, "stg_order_payments"))


@query("fact_orders_of_month")
def _fact_orders_of_month(c: Context) -> DataFrame:
    """The fact as stored by month, every row with its month."""
    return sinks.overwrite_table(c.fact_orders_by_month, _scratch(c, "fact_orders"), partition_by=["year_month"])


@query("overwrite_partitions")
def _overwrite_partitions(c: Context) -> DataFrame:
    """A fact stored by month, of which the months with a 3 as last digit are written again with other flags."""
    path, fact = _scratch(c, "fact_orders"), c.fact_orders_by_month
    sinks.overwrite_table(fact, path, partition_by=["year_month"])
    changed = fact.filter("year_month like '%3'").withColumn("is_canceled", F.lit(9))
    return sinks.overwrite_partitions(changed, path)


@query("register_view")
def _register_view(c: Context) -> DataFrame:
    sinks.register_view(c.vw_delivered_orders, "vw_delivered_orders")
    return c.spark.sql(
        "select year_month, count(*) as order_cnt, min(delivery_lead_days) as fastest from vw_delivered_orders group by year_month"
    )


@query("row_count_report")
def _row_count_report(c: Context) -> DataFrame:
    raw = {name: c.raw(name) for name in driver_tables.ADAPTERS}
    return sinks.row_count_report({**raw, **{n: c.table(n) for tables in LAYERS.values() for n in tables}})


@query("sample_rows")
def _sample_rows(c: Context) -> DataFrame:
    columns = ["order_id", "order_item_id", "product_id", "item_total_value"]
    rows = c.stg_order_items.select(*columns)
    return sinks.sample_rows(rows, 50, [F.col("item_total_value").desc(), *columns[:3]])


@query("schema_report")
def _schema_report(c: Context) -> DataFrame:
    return sinks.schema_report(c.stg_products)


@query("schema_report_all")
def _schema_report_all(c: Context) -> DataFrame:
    """Every column of every table of the layers."""
    return union_all(
        [
            sinks.schema_report(c.table(name)).select(F.lit(name).alias("table_name"), "ordinal", "column_name", "data_type", "present_cnt")
            for tables in LAYERS.values()
            for name in tables
        ]
    )


# --- staging -------------------------------------------------------------------------------------

for _name in (
    "stg_orders",
    "stg_customers",
    "stg_order_items",
    "stg_products",
    "stg_sellers",
    "stg_order_payments",
    "stg_order_reviews",
    "stg_geolocation",
):
    query(_name)(lambda c, _name=_name: c.table(_name))


@query("clean_text")
def _clean_text(c: Context) -> DataFrame:
    return c.raw("order_reviews").select(
        "review_id",
        fx.clean_text("review_comment_title").alias("title_kept"),
        fx.clean_text("review_comment_title", case="upper", blank_to_null=True).alias("title_upper"),
        fx.clean_text("review_comment_message", case="lower", blank_to_null=True).alias("message_lower"),
        fx.clean_text("review_comment_message", drop_cr=False).alias("message_with_cr"),
    )


@query("parse_ts")
def _parse_ts(c: Context) -> DataFrame:
    times = ["order_purchase_timestamp", "order_approved_at", "order_delivered_customer_date"]
    return c.raw("orders").select("order_id", *[fx.parse_ts(t).alias(t) for t in times])


def _parsed(c: Context) -> DataFrame:
    return staging.parsed_orders(c.raw("orders")).filter(F.col("order_purchase_dt").isNotNull())


@query("calendar_parts")
def _calendar_parts(c: Context) -> DataFrame:
    day = F.col("order_purchase_dt").cast("date").alias("order_date")
    return _parsed(c).select("order_id", day, *fx.calendar_parts("order_purchase_dt"))


for _name, _columns in {
    "approve_lead_days": ["approve_lead_days"],
    "delivery_lead_days": ["delivery_lead_days"],
    "delivery_delay_days": ["delivery_delay_days"],
    "delivered_canceled_flags": ["is_delivered", "is_canceled"],
    "is_time_inconsistent": ["is_time_inconsistent"],
    "is_status_inconsistent": ["is_status_inconsistent"],
    "is_carrier_dt_missing": ["is_carrier_dt_missing"],
}.items():
    query(_name)(
        lambda c, _columns=_columns: _parsed(c).select("order_id", *[getattr(staging, n)().alias(n) for n in _columns])
    )


@query("lookup_translate")
def _lookup_translate(c: Context) -> DataFrame:
    return staging.lookup_translate(
        c.raw("products").select("product_id", "product_category_name"),
        c.raw("category_translation"),
        "product_category_name",
        "product_category_name",
        "product_category_name_english",
        "category_en",
        "is_translated",
    ).select("product_id", "product_category_name", "category_en", "is_translated")


@query("volume_cm3")
def _volume_cm3(c: Context) -> DataFrame:
    volume = staging.volume_cm3("product_length_cm", "product_height_cm", "product_width_cm")
    return c.raw("products").select("product_id", volume.alias("product_volume_cm3"))


@query("product_flags")
def _product_flags(c: Context) -> DataFrame:
    return c.stg_products.select("product_id", "is_category_blank", "is_category_en_unmapped", "is_weight_zero")


def _points(c: Context) -> DataFrame:
    return staging.geo_points(c.raw("geolocation"))


@query("geo_valid_flag")
def _geo_valid_flag(c: Context) -> DataFrame:
    return _points(c).groupBy("zip_prefix", "is_valid").agg(F.count(F.lit(1)).alias("cnt"))


@query("geo_zip_agg")
def _geo_zip_agg(c: Context) -> DataFrame:
    return staging.geo_zip_agg(_points(c))


@query("mode_by_key_point")
def _mode_by_key_point(c: Context) -> DataFrame:
    return staging.geo_point_mode(_points(c))


@query("mode_by_key_place")
def _mode_by_key_place(c: Context) -> DataFrame:
    return staging.geo_place_mode(_points(c))


@query("mode_by_key_collated")
def _mode_by_key_collated(c: Context) -> DataFrame:
    """Raw spellings that are equal without case meet under the collation."""
    points = c.raw("geolocation").select(
        F.col("geolocation_zip_code_prefix").alias("zip_prefix"),
        F.replace("geolocation_city", F.lit("\r"), F.lit("")).alias("city"),
        F.col("geolocation_state").alias("state"),
    )
    return staging.geo_place_mode(points, collation="UNICODE_CI_AI")


@query("stg_geolocation_collated")
def _stg_geolocation_collated(c: Context) -> DataFrame:
    """The whole table as a database compares that is blind to case and accents; points in the north are spelled with accents."""
    accented = F.translate("geolocation_city", "aAeEiI", "áÁéÉíÍ")
    north = F.when(F.col("geolocation_lat") > -16, accented).otherwise(F.col("geolocation_city"))
    return staging.stg_geolocation(c.raw("geolocation").withColumn("geolocation_city", north), collation=ACCENT_FREE)


@query("geo_assemble")
def _geo_assemble(c: Context) -> DataFrame:
    points = _points(c)
    return staging.geo_assemble(
        staging.geo_zip_agg(points), staging.geo_point_mode(points), staging.geo_place_mode(points)
    )


# --- star schema -----------------------------------------------------------------------------------

for _name in (
    "dim_date",
    "dim_geolocation",
    "dim_customer",
    "dim_product",
    "dim_seller",
    "fact_order_items",
    "fact_orders",
    "vw_delivered_orders",
    "vw_delivered_order_items",
    "vw_customer_first_purchase_month",
):
    query(_name)(lambda c, _name=_name: c.table(_name))


@query("date_bounds")
def _date_bounds(c: Context) -> DataFrame:
    return date_bounds(c.stg_orders, marts.ORDER_DATES)


@query("generate_calendar")
def _generate_calendar(c: Context) -> DataFrame:
    return generate_calendar(date_bounds(c.stg_orders, marts.ORDER_DATES))


@query("calendar_attributes")
def _calendar_attributes(c: Context) -> DataFrame:
    """Attributes of the days on which something was bought."""
    return c.stg_orders.select("order_purchase_date").distinct().select(*fx.calendar_attributes("order_purchase_date"))


# --- monthly KPIs and cohorts ------------------------------------------------------------------------

for _name in ("base_customer_monthly_purchase", "kpi_monthly_core", "kpi_monthly_cancellation", "cohort_monthly_core"):
    query(_name)(lambda c, _name=_name: c.table(_name))

for _name in ("buyers", "orders", "revenue", "retention", "aov"):
    query(f"cohort_pivot_{_name}")(lambda c, _name=_name: analysis.cohort_pivot(c.cohort_monthly_core, _name))


@query("base_orders")
def _base_orders(c: Context) -> DataFrame:
    return analysis.base_orders(c.vw_delivered_orders, c.dim_customer)


@query("base_items")
def _base_items(c: Context) -> DataFrame:
    return analysis.base_items(c.vw_delivered_order_items, c.dim_customer)


@query("month_offset")
def _month_offset(c: Context) -> DataFrame:
    months = [fx.month_label(d).alias(n) for n, d in (("bought", "order_purchase_dt"), ("due", "order_estimated_delivery_dt"))]
    shipped = fx.month_label("order_delivered_carrier_dt").alias("shipped")
    return c.stg_orders.select("order_id", *months, shipped).select(
        "order_id",
        fx.month_offset("bought", "due").alias("months_to_due"),
        fx.month_offset("bought", "shipped").alias("months_to_shipping"),
    )


@query("new_repeat_flags")
def _new_repeat_flags(c: Context) -> DataFrame:
    return c.base_customer_monthly_purchase.select(
        "customer_unique_id", "year_month", "is_active", "is_new_buyer", "is_repeat_buyer"
    )


@query("dense_months")
def _dense_months(c: Context) -> DataFrame:
    return dense_months(c.dim_date)


@query("safe_ratio")
def _safe_ratio(c: Context) -> DataFrame:
    """Mean freight per installment of each order; NULL where there are no installments."""
    totals = c.stg_order_payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("paid"), F.sum("payment_installments").alias("installments")
    )
    return totals.select(
        "order_id", fx.safe_ratio(F.col("paid"), F.col("installments"), "decimal(18,2)", "decimal(18,2)").alias("per_installment")
    )


@query("conditional_distinct")
def _conditional_distinct(c: Context) -> DataFrame:
    """Distinct products per seller, and those sold dear or in the first line of an order."""
    return conditional_distinct(
        c.stg_order_items,
        ["seller_id"],
        "product_id",
        {"products": None, "dear_products": F.col("price") > 30000, "first_line_products": F.col("order_item_seq") == 1},
    )


@query("cohort_matrix")
def _cohort_matrix(c: Context) -> DataFrame:
    return analysis.cohort_matrix(c.base_customer_monthly_purchase, analysis.last_calendar_month(c.dim_date))


@query("cohort_base_agg")
def _cohort_base_agg(c: Context) -> DataFrame:
    return analysis.cohort_base_agg(c.base_customer_monthly_purchase)


@query("cohort_size")
def _cohort_size(c: Context) -> DataFrame:
    return analysis.cohort_size(c.base_customer_monthly_purchase)


@query("cohort_retention_aov")
def _cohort_retention_aov(c: Context) -> DataFrame:
    return c.cohort_monthly_core.select("cohort_year_month", "month_n", "cohort_retention_rate", "cohort_aov")


@query("cohort_cumulative")
def _cohort_cumulative(c: Context) -> DataFrame:
    """Running totals over the observed months only."""
    observed = analysis.cohort_base_agg(c.base_customer_monthly_purchase)
    return observed.select("cohort_year_month", "month_n", *analysis.cohort_cumulative())


# --- documented KPIs -----------------------------------------------------------------------------------


@query("kpi_sales_summary")
def _kpi_sales_summary(c: Context) -> DataFrame:
    return kpis.kpi_sales_summary(c.vw_delivered_order_items)


@query("kpi_sales_summary_monthly")
def _kpi_sales_summary_monthly(c: Context) -> DataFrame:
    return kpis.kpi_sales_summary(c.vw_delivered_order_items, "year_month")


@query("revenue_by_category")
def _revenue_by_category(c: Context) -> DataFrame:
    return kpis.revenue_by_category(c.vw_delivered_order_items, c.dim_product)


@query("revenue_by_customer_region")
def _revenue_by_customer_region(c: Context) -> DataFrame:
    return kpis.revenue_by_region(c.vw_delivered_order_items, c.dim_geolocation, "customer")


@query("revenue_by_seller_region")
def _revenue_by_seller_region(c: Context) -> DataFrame:
    return kpis.revenue_by_region(c.vw_delivered_order_items, c.dim_geolocation, "seller")


@query("kpi_operations_summary")
def _kpi_operations_summary(c: Context) -> DataFrame:
    return kpis.kpi_operations_summary(c.fact_orders)


@query("kpi_operations_summary_monthly")
def _kpi_operations_summary_monthly(c: Context) -> DataFrame:
    dated = c.fact_orders.withColumn("year_month", fx.month_label("order_purchase_dt"))
    return kpis.kpi_operations_summary(dated, "year_month")


@query("overall_repeat_rate")
def _overall_repeat_rate(c: Context) -> DataFrame:
    return kpis.overall_repeat_rate(c.base_customer_monthly_purchase)


for _name in ("month", "quarter", "year"):
    query(f"revenue_trend_{_name}")(lambda c, _name=_name: kpis.revenue_trend(c.kpi_monthly_core, _name))


@query("cancellation_by_category")
def _cancellation_by_category(c: Context) -> DataFrame:
    labelled = kpis.orders_by_category(c.fact_orders, c.fact_order_items_by_order, c.dim_product)
    return kpis.cancellation_breakdown(labelled, "product_category_name")


@query("cancellation_by_seller")
def _cancellation_by_seller(c: Context) -> DataFrame:
    return kpis.cancellation_breakdown(kpis.orders_by_seller(c.fact_orders, c.fact_order_items_by_order), "seller_id")


@query("cancellation_by_region")
def _cancellation_by_region(c: Context) -> DataFrame:
    return kpis.cancellation_breakdown(kpis.orders_by_region(c.fact_orders, c.dim_geolocation), "city_state")


@query("dense_customer_month")
def _dense_customer_month(c: Context) -> DataFrame:
    return analysis.dense_customer_month(
        c.base_customer_monthly_purchase, analysis.last_calendar_month(c.dim_date)
    )


@query("join_integrity_flags")
def _join_integrity_flags(c: Context) -> DataFrame:
    return kpis.join_integrity_flags(c.stg_orders, c.stg_order_items, c.stg_order_payments, c.stg_order_reviews)


@query("orders_vs_aov_decomposition")
def _orders_vs_aov_decomposition(c: Context) -> DataFrame:
    return kpis.orders_vs_aov_decomposition(c.kpi_monthly_core)
