"""Data-quality queries, one or more per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewinds import functions as fx
from tradewinds.functions.ratios import MONEY_TYPE
from tradewinds.operators import quality as qc
from tradewinds.plans import analysis, kpis, marts, quality_suite, staging
from tradewinds.registry.base import Context, query
from tradewinds.sources.schemas import columns_of

# --- keys -------------------------------------------------------------------------------------


@query("unique_key_profile")
def _unique_key_profile(c: Context) -> DataFrame:
    return qc.unique_key_profile(c.raw("orders"), "order_id")


@query("unique_key_profile_customer")
def _unique_key_profile_customer(c: Context) -> DataFrame:
    return qc.unique_key_profile(c.raw("customers"), "customer_unique_id")


@query("duplicate_key_groups")
def _duplicate_key_groups(c: Context) -> DataFrame:
    return qc.duplicate_key_groups(c.raw("order_items"), ["order_id", "order_item_id"])


@query("duplicate_key_groups_points")
def _duplicate_key_groups_points(c: Context) -> DataFrame:
    keys = ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng"]
    return qc.duplicate_key_groups(c.raw("geolocation"), keys)


@query("composite_unique_profile")
def _composite_unique_profile(c: Context) -> DataFrame:
    return qc.composite_unique_profile(c.fact_order_items_by_order, ["order_id", "order_item_id"])


@query("composite_unique_profile_person_month")
def _composite_unique_profile_person_month(c: Context) -> DataFrame:
    return qc.composite_unique_profile(c.base_customer_monthly_purchase, ["customer_unique_id", "year_month"])


for _name, _build in {
    "pk_uniqueness_summary": quality_suite.pk_uniqueness,
    "pk_null_summary": quality_suite.pk_nulls,
    "critical_null_summary": quality_suite.critical_nulls,
    "flag_snapshot": quality_suite.flags,
    "domain_range_rules": quality_suite.domains,
    "referential_summary": quality_suite.references,
    "row_count_reconcile": quality_suite.row_counts,
    "run_qc": quality_suite.run_qc,
}.items():
    query(_name)(_build)

# --- values -----------------------------------------------------------------------------------


@query("null_blank_counts")
def _null_blank_counts(c: Context) -> DataFrame:
    columns = ["order_id", "customer_id", "order_status", "order_approved_at", "order_delivered_customer_date"]
    return qc.null_blank_counts(c.raw("orders"), columns)


@query("null_blank_counts_reviews")
def _null_blank_counts_reviews(c: Context) -> DataFrame:
    return qc.null_blank_counts(c.raw("order_reviews"), ["review_comment_title", "review_comment_message"], cleaned=True)


@query("null_blank_counts_fact")
def _null_blank_counts_fact(c: Context) -> DataFrame:
    columns = ["order_purchase_date_key", "customer_id", "customer_zip_code_prefix", "seller_zip_code_prefix"]
    return qc.null_blank_counts(c.fact_order_items, columns)


ORDER_TIMES = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]


@query("parse_failure_counts")
def _parse_failure_counts(c: Context) -> DataFrame:
    return qc.parse_failure_counts(c.raw("orders"), ORDER_TIMES)


@query("value_distribution")
def _value_distribution(c: Context) -> DataFrame:
    return qc.value_distribution(c.raw("orders"), fx.clean_text("order_status", case="lower"), "order_status")


@query("value_distribution_cohorts")
def _value_distribution_cohorts(c: Context) -> DataFrame:
    return qc.value_distribution(c.vw_customer_first_purchase_month, "first_purchase_year_month", "year_month")


@query("value_share")
def _value_share(c: Context) -> DataFrame:
    return qc.value_share(c.raw("geolocation"), fx.clean_text("geolocation_state", case="upper"), "state")


@query("value_share_payments")
def _value_share_payments(c: Context) -> DataFrame:
    return qc.value_share(c.stg_order_payments, "payment_type", "payment_type")


@query("value_share_sellers")
def _value_share_sellers(c: Context) -> DataFrame:
    return qc.value_share(c.stg_sellers, "seller_city_state", "seller_city_state")


@query("numeric_profile")
def _numeric_profile(c: Context) -> DataFrame:
    return qc.numeric_profile(c.stg_order_items, ["price", "freight_value", "item_total_value", "order_item_seq"])


@query("numeric_profile_products")
def _numeric_profile_products(c: Context) -> DataFrame:
    return qc.numeric_profile(
        c.stg_products,
        [
            "product_name_length",
            "product_description_length",
            "product_photos_qty",
            "product_weight_g",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
            "product_volume_cm3",
        ],
    )


@query("numeric_profile_payments")
def _numeric_profile_payments(c: Context) -> DataFrame:
    return qc.numeric_profile(c.raw("order_payments"), ["payment_sequential", "payment_installments", "payment_value"])


@query("count_of_counts")
def _count_of_counts(c: Context) -> DataFrame:
    return qc.count_of_counts(c.raw("order_payments"), "order_id")


@query("count_of_counts_cities")
def _count_of_counts_cities(c: Context) -> DataFrame:
    city = F.trim(F.upper("geolocation_city"))
    return qc.count_of_counts(c.raw("geolocation"), "geolocation_zip_code_prefix", distinct=city)


@query("top_n_groups")
def _top_n_groups(c: Context) -> DataFrame:
    return qc.top_n_groups(c.raw("geolocation"), "geolocation_zip_code_prefix", 20)


@query("top_n_groups_spread")
def _top_n_groups_spread(c: Context) -> DataFrame:
    """Zips whose points lie furthest apart."""
    lat, lng = F.col("geolocation_lat"), F.col("geolocation_lng")
    return qc.top_n_groups(
        c.raw("geolocation"),
        "geolocation_zip_code_prefix",
        20,
        [F.col("lat_range").desc(), F.col("lng_range").desc()],
        row_cnt=F.count(F.lit(1)),
        distinct_point_cnt=F.count_distinct(lat, lng),
        lat_range=(F.max(lat) - F.min(lat)).cast("decimal(11,6)"),
        lng_range=(F.max(lng) - F.min(lng)).cast("decimal(11,6)"),
    )


@query("string_shape")
def _string_shape(c: Context) -> DataFrame:
    return qc.string_shape(c.raw("customers"), "customer_zip_code_prefix", 5)


@query("string_shape_state")
def _string_shape_state(c: Context) -> DataFrame:
    return qc.string_shape(c.raw("customers"), "customer_state", 2)


@query("normalisation_effect")
def _normalisation_effect(c: Context) -> DataFrame:
    return qc.normalisation_effect(
        c.raw("geolocation"), {"geolocation_city": lambda x: fx.clean_text(x, case="lower")}
    )


@query("normalisation_effect_pair")
def _normalisation_effect_pair(c: Context) -> DataFrame:
    return qc.normalisation_effect(
        c.raw("geolocation"),
        {
            "geolocation_city": lambda x: fx.clean_text(x, case="lower"),
            "geolocation_state": lambda x: fx.clean_text(x, case="upper"),
        },
    )


@query("multi_mapped_keys")
def _multi_mapped_keys(c: Context) -> DataFrame:
    return qc.multi_mapped_keys(c.raw("geolocation"), "geolocation_zip_code_prefix", "geolocation_state")


@query("multi_mapped_values")
def _multi_mapped_values(c: Context) -> DataFrame:
    return qc.multi_mapped_values(c.raw("geolocation"), "geolocation_zip_code_prefix", "geolocation_state")


@query("geo_out_of_bounds")
def _geo_out_of_bounds(c: Context) -> DataFrame:
    return qc.geo_out_of_bounds(
        c.raw("geolocation"), "geolocation_lat", "geolocation_lng", staging.LAT_RANGE, staging.LNG_RANGE
    )


@query("row_filter_listing")
def _row_filter_listing(c: Context) -> DataFrame:
    return qc.row_filter_listing(c.stg_order_payments, F.col("payment_value") == 0)


@query("mode_confidence")
def _mode_confidence(c: Context) -> DataFrame:
    points = staging.geo_points(c.raw("geolocation"))
    return qc.mode_confidence(points, "zip_prefix", ["lat", "lng"], F.col("is_valid") == 1)


@query("mode_confidence_low")
def _mode_confidence_low(c: Context) -> DataFrame:
    """Zips whose most frequent point holds less than a twentieth of their rows."""
    columns = ["geolocation_zip_code_prefix", "row_cnt", "mode_cnt", "mode_ratio_pct"]
    return qc.row_filter_listing(c.stg_geolocation, F.col("mode_ratio_pct") < 5, columns)


@query("mode_confidence_low_gap")
def _mode_confidence_low_gap(c: Context) -> DataFrame:
    """The same with a bound that many zips are below."""
    columns = ["geolocation_zip_code_prefix", "row_cnt", "mode_cnt", "mode_ratio_pct"]
    return qc.row_filter_listing(c.stg_geolocation, F.col("mode_ratio_pct") < 30, columns)


@query("mode_confidence_summary")
def _mode_confidence_summary(c: Context) -> DataFrame:
    return qc.mode_confidence_summary(c.stg_geolocation, "mode_ratio_pct", 5)


# --- row rules --------------------------------------------------------------------------------------


@query("event_order_anomalies")
def _event_order_anomalies(c: Context) -> DataFrame:
    times = ["order_approved_dt", "order_delivered_carrier_dt", "order_delivered_customer_dt"]
    return qc.event_order_anomalies(staging.parsed_orders(c.raw("orders")), "order_purchase_dt", times)


@query("event_order_anomaly_rows")
def _event_order_anomaly_rows(c: Context) -> DataFrame:
    early = F.col("order_delivered_carrier_dt") < F.col("order_purchase_dt")
    columns = ["order_id", "order_status", "order_purchase_dt", "order_delivered_carrier_dt"]
    return qc.row_filter_listing(staging.parsed_orders(c.raw("orders")), early, columns)


@query("status_time_contradictions")
def _status_time_contradictions(c: Context) -> DataFrame:
    return qc.status_time_contradictions(staging.parsed_orders(c.raw("orders")))


@query("negative_values")
def _negative_values(c: Context) -> DataFrame:
    return qc.negative_values(c.stg_orders, ["approve_lead_days", "delivery_lead_days", "delivery_delay_days"])


@query("negative_values_kpi")
def _negative_values_kpi(c: Context) -> DataFrame:
    return qc.negative_values(c.kpi_monthly_core, ["gross_revenue", "order_cnt", "active_buyers", "aov", "repeat_buyers"])


@query("flag_counts")
def _flag_counts(c: Context) -> DataFrame:
    return qc.flag_counts(c.stg_orders, ["is_time_inconsistent", "is_status_inconsistent", "is_carrier_dt_missing"])


@query("derived_consistency")
def _derived_consistency(c: Context) -> DataFrame:
    formula = F.col("price") + F.col("freight_value")
    return qc.derived_consistency(c.stg_order_items, "item_total_value", formula, ["price", "freight_value"])


@query("derived_consistency_gap")
def _derived_consistency_gap(c: Context) -> DataFrame:
    """The item total against the bare price: differs wherever there is freight."""
    return qc.derived_consistency(c.stg_order_items, "item_total_value", F.col("price"), ["price"])


@query("flag_rule_consistency")
def _flag_rule_consistency(c: Context) -> DataFrame:
    return qc.flag_rule_consistency(
        c.stg_geolocation,
        {
            "invalid_latlng": ("is_invalid_latlng_exists", F.col("invalid_latlng_cnt") > 0),
            "multi_city": ("is_multi_city", F.col("city_cnt") > 1),
            "multi_state": ("is_multi_state", F.col("state_cnt") > 1),
            "point_known": ("is_invalid_latlng_exists", F.col("geolocation_lat").isNull()),
        },
    )


@query("flag_rule_consistency_products")
def _flag_rule_consistency_products(c: Context) -> DataFrame:
    return qc.flag_rule_consistency(
        c.dim_product,
        {
            "category_blank": ("is_category_blank", F.col("product_category_name").isNull()),
            "category_unmapped": (
                "is_category_en_unmapped",
                F.col("product_category_name").isNotNull() & F.col("product_category_name_en").isNull(),
            ),
            "weight_zero": ("is_weight_zero", F.col("product_weight_g") == 0),
            "weight_known": ("is_weight_zero", F.col("product_weight_g").isNotNull()),
        },
    )


@query("flag_agreement_reviews")
def _flag_agreement_reviews(c: Context) -> DataFrame:
    """Blank flags of the reviews against the cleaned text."""
    return qc.flag_rule_consistency(
        c.stg_order_reviews,
        {
            "title_blank": ("is_title_blank", F.col("review_comment_title").isNull()),
            "message_blank": ("is_message_blank", F.col("review_comment_message").isNull()),
            "title_blank_as_message": ("is_title_blank", F.col("review_comment_message").isNull()),
        },
    )


@query("flag_rule_consistency_calendar")
def _flag_rule_consistency_calendar(c: Context) -> DataFrame:
    day = F.col("date")
    return qc.flag_rule_consistency(
        c.dim_date,
        {
            "weekend": ("is_weekend", F.col("day_of_week").isin(6, 7)),
            "month_start": ("is_month_start", F.dayofmonth(day) == 1),
            "month_end": ("is_month_end", day == F.last_day(day)),
            "weekend_is_month_end": ("is_weekend", F.col("is_month_end") == 1),
        },
    )


# --- references ---------------------------------------------------------------------------------------


@query("orphan_count")
def _orphan_count(c: Context) -> DataFrame:
    """Orders without items."""
    return qc.orphan_count(c.raw("orders"), "order_id", c.raw("order_items"), "order_id")


@query("orphan_count_payments")
def _orphan_count_payments(c: Context) -> DataFrame:
    """Payments whose order did not reach staging."""
    return qc.orphan_count(c.stg_order_payments, "order_id", c.stg_orders, "order_id")


@query("orphan_count_zip")
def _orphan_count_zip(c: Context) -> DataFrame:
    return qc.orphan_count(
        c.fact_order_items, "seller_zip_code_prefix", c.dim_geolocation, "geolocation_zip_code_prefix"
    )


@query("orphan_values")
def _orphan_values(c: Context) -> DataFrame:
    return qc.orphan_values(c.raw("orders"), "order_id", c.raw("order_payments"), "order_id")


@query("orphan_drilldown")
def _orphan_drilldown(c: Context) -> DataFrame:
    raw_zip = fx.clean_text("geolocation_zip_code_prefix")
    return qc.orphan_drilldown(
        c.stg_customers,
        "customer_zip_code_prefix",
        c.stg_geolocation,
        "geolocation_zip_code_prefix",
        c.raw("geolocation"),
        raw_zip,
    )


@query("coverage_pct")
def _coverage_pct(c: Context) -> DataFrame:
    return qc.coverage_pct(
        c.stg_customers, "customer_zip_code_prefix", c.stg_geolocation, "geolocation_zip_code_prefix"
    )


@query("coverage_pct_orders")
def _coverage_pct_orders(c: Context) -> DataFrame:
    return qc.coverage_pct(c.stg_order_reviews, "order_id", c.stg_orders, "order_id")


@query("cross_table_event_order")
def _cross_table_event_order(c: Context) -> DataFrame:
    return qc.cross_table_event_order(
        c.stg_order_items, "shipping_limit_dt", c.stg_orders, "order_purchase_dt", "order_id"
    )


@query("cross_table_event_order_reviews")
def _cross_table_event_order_reviews(c: Context) -> DataFrame:
    return qc.cross_table_event_order(
        c.stg_order_reviews, "review_creation_dt", c.stg_orders, "order_purchase_dt", "order_id"
    )


@query("event_gap_histogram")
def _event_gap_histogram(c: Context) -> DataFrame:
    return qc.event_gap_histogram(
        c.stg_order_items, "shipping_limit_dt", c.stg_orders, "order_approved_dt", "order_id"
    )


@query("anomaly_attribution")
def _anomaly_attribution(c: Context) -> DataFrame:
    """Payments of orders reviewed too early: in orders paid once or in several parts?"""
    early = kpis.join_integrity_flags(
        c.stg_orders, c.stg_order_items, c.stg_order_payments, c.stg_order_reviews
    ).filter("is_reviewed_before_purchase = 1 or is_without_items = 1")
    return qc.anomaly_attribution(early, c.stg_order_payments, "order_id")


# --- layers ----------------------------------------------------------------------------------------------


@query("copy_mismatch")
def _copy_mismatch(c: Context) -> DataFrame:
    columns = ["customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state", "customer_city_state"]
    return qc.copy_mismatch(c.dim_customer, c.stg_customers, "customer_id", columns)


@query("copy_mismatch_raw")
def _copy_mismatch_raw(c: Context) -> DataFrame:
    """Staging against raw: what the cleaning changed."""
    columns = ["seller_zip_code_prefix", "seller_city", "seller_state"]
    return qc.copy_mismatch(c.stg_sellers, c.raw("sellers"), "seller_id", columns)


@query("view_vs_source")
def _view_vs_source(c: Context) -> DataFrame:
    months = fx.month_label("order_purchase_dt").alias("year_month")
    delivered = c.stg_orders.filter("order_status = 'delivered' and is_delivered = 1").select("order_id", months)
    source = delivered.groupBy("year_month").agg(F.count(F.lit(1)).alias("order_cnt"))
    return qc.view_vs_source(c.kpi_monthly_core, source, ["year_month"], ["order_cnt"], missing_as=0)


@query("view_vs_source_gap")
def _view_vs_source_gap(c: Context) -> DataFrame:
    """Delivered orders against all orders per month."""
    everything = c.kpi_monthly_cancellation.select("year_month", F.col("total_orders").alias("order_cnt"))
    return qc.view_vs_source(c.kpi_monthly_core, everything, ["year_month"], ["order_cnt"], missing_as=0)


@query("grand_total_reconcile")
def _grand_total_reconcile(c: Context) -> DataFrame:
    core, base, items = c.kpi_monthly_core, c.base_customer_monthly_purchase, c.vw_delivered_order_items
    cohorts = c.cohort_monthly_core
    return qc.grand_total_reconcile(
        {
            "revenue: items vs months": ((items, F.sum("item_total_value")), (core, F.sum("gross_revenue"))),
            "revenue: persons vs cohorts": ((base, F.sum("gross_revenue")), (cohorts, F.sum("cohort_gross_revenue"))),
            "orders: persons vs cohorts": ((base, F.sum("order_cnt")), (cohorts, F.sum("cohort_order_cnt"))),
        }
    )


@query("grand_total_reconcile_gap")
def _grand_total_reconcile_gap(c: Context) -> DataFrame:
    """All orders against delivered ones: differs."""
    orders, core = c.fact_orders, c.kpi_monthly_core
    return qc.grand_total_reconcile({"orders: all vs delivered": ((orders, F.count(F.lit(1))), (core, F.sum("order_cnt")))})


@query("row_count_reconcile_star")
def _row_count_reconcile_star(c: Context) -> DataFrame:
    """Staging against the star schema, and a lookup that must not change the number of rows."""
    items_with_order = c.stg_order_items.join(c.stg_orders.select("order_id"), "order_id")
    return qc.row_count_reconcile(
        {
            "customers": (c.stg_customers, c.dim_customer),
            "products": (c.stg_products, c.dim_product),
            "sellers": (c.stg_sellers, c.dim_seller),
            "geolocation": (c.stg_geolocation, c.dim_geolocation),
            "orders": (c.stg_orders, c.fact_orders),
            "order_items": (c.stg_order_items, c.fact_order_items),
            "order_items with an order": (items_with_order, c.fact_order_items),
        }
    )


@query("view_vs_source_person_month")
def _view_vs_source_person_month(c: Context) -> DataFrame:
    """Orders, items and revenue of persons and months, recomputed from the views of delivered orders and items."""
    keys, measures = ["customer_unique_id", "year_month"], ["order_cnt", "item_cnt", "gross_revenue"]
    orders = analysis.base_orders(c.vw_delivered_orders, c.dim_customer)
    source = orders.join(analysis.base_items(c.vw_delivered_order_items, c.dim_customer), keys)
    return qc.view_vs_source(c.base_customer_monthly_purchase, source, keys, measures)


@query("view_vs_source_person_month_gap")
def _view_vs_source_person_month_gap(c: Context) -> DataFrame:
    """Orders against items of persons and months: differs where an order has several items."""
    keys = ["customer_unique_id", "year_month"]
    items = analysis.base_items(c.vw_delivered_order_items, c.dim_customer)
    return qc.view_vs_source(c.base_customer_monthly_purchase, items.select(*keys, F.col("item_cnt").alias("order_cnt")), keys, ["order_cnt"])


for _name, _dim, _stg, _key in (
    ("copy_mismatch_geolocation", "dim_geolocation", "stg_geolocation", "geolocation_zip_code_prefix"),
    ("copy_mismatch_product", "dim_product", "stg_products", "product_id"),
    ("copy_mismatch_seller", "dim_seller", "stg_sellers", "seller_id"),
):
    query(_name)(
        lambda c, _dim=_dim, _stg=_stg, _key=_key: qc.copy_mismatch(
            c.table(_dim), c.table(_stg), _key, [x for x in columns_of(_dim) if x != _key]
        )
    )


# --- KPI and cohort invariants ------------------------------------------------------------------------------


@query("buyer_flag_invariants")
def _buyer_flag_invariants(c: Context) -> DataFrame:
    return qc.buyer_flag_invariants(c.base_customer_monthly_purchase)


@query("kpi_range_report")
def _kpi_range_report(c: Context) -> DataFrame:
    kpi_cols = ["gross_revenue", "order_cnt", "active_buyers", "aov", "repeat_buyers", "repeat_buyer_rate"]
    return qc.kpi_range_report(c.kpi_monthly_core, kpi_cols)


@query("kpi_range_report_cancellation")
def _kpi_range_report_cancellation(c: Context) -> DataFrame:
    counts = ["total_orders", "canceled_orders", "unavailable_orders", "failed_orders"]
    return qc.kpi_range_report(c.kpi_monthly_cancellation, [*counts, "cancel_rate", "unavailable_rate", "failed_rate"])


@query("kpi_range_report_cohorts")
def _kpi_range_report_cohorts(c: Context) -> DataFrame:
    return qc.kpi_range_report(
        c.cohort_monthly_core,
        [
            "month_n",
            "cohort_size",
            "cohort_active_buyers",
            "cohort_order_cnt",
            "cohort_gross_revenue",
            "cohort_retention_rate",
            "cohort_aov",
            "cum_gross_revenue",
            "cum_order_cnt",
        ],
    )


@query("month_axis_completeness")
def _month_axis_completeness(c: Context) -> DataFrame:
    return qc.month_axis_completeness(
        {
            "kpi_monthly_core": c.kpi_monthly_core,
            "kpi_monthly_cancellation": c.kpi_monthly_cancellation,
            "vw_delivered_orders": c.vw_delivered_orders,
            "dim_date": c.dim_date,
        }
    )


@query("sum_identity")
def _sum_identity(c: Context) -> DataFrame:
    return qc.sum_identity(
        c.kpi_monthly_cancellation, "year_month", ["canceled_orders", "unavailable_orders"], "failed_orders"
    )


@query("sum_identity_gap")
def _sum_identity_gap(c: Context) -> DataFrame:
    """Failed orders alone are not all orders."""
    return qc.sum_identity(
        c.kpi_monthly_cancellation, "year_month", ["canceled_orders", "unavailable_orders"], "total_orders"
    )


@query("sequence_gap")
def _sequence_gap(c: Context) -> DataFrame:
    return qc.sequence_gap(c.cohort_monthly_core, "cohort_year_month", "month_n")


@query("sequence_gap_sparse")
def _sequence_gap_sparse(c: Context) -> DataFrame:
    """Observed cohort months only: silent months show up as gaps."""
    observed = analysis.cohort_base_agg(c.base_customer_monthly_purchase)
    return qc.sequence_gap(observed, "cohort_year_month", "month_n")


@query("constant_within_group")
def _constant_within_group(c: Context) -> DataFrame:
    return qc.constant_within_group(c.cohort_monthly_core, "cohort_year_month", "cohort_size")


@query("constant_within_group_gap")
def _constant_within_group_gap(c: Context) -> DataFrame:
    return qc.constant_within_group(c.cohort_monthly_core, "cohort_year_month", "cohort_active_buyers")


@query("ratio_recompute")
def _ratio_recompute(c: Context) -> DataFrame:
    again = fx.safe_ratio(F.col("cohort_active_buyers"), F.col("cohort_size"))
    return qc.ratio_recompute(
        c.cohort_monthly_core, ["cohort_year_month", "month_n"], "cohort_retention_rate", again, "0.000001"
    )


@query("ratio_recompute_gap")
def _ratio_recompute_gap(c: Context) -> DataFrame:
    """Average order value against revenue per buyer: differs where buyers order more than once a month."""
    again = fx.safe_ratio(F.col("cohort_gross_revenue"), F.col("cohort_active_buyers"), MONEY_TYPE, MONEY_TYPE)
    return qc.ratio_recompute(c.cohort_monthly_core, ["cohort_year_month", "month_n"], "cohort_aov", again, "0.01")


@query("monotone_cumulative")
def _monotone_cumulative(c: Context) -> DataFrame:
    return qc.monotone_cumulative(c.cohort_monthly_core, "cohort_year_month", "month_n", "cum_gross_revenue")


@query("monotone_cumulative_gap")
def _monotone_cumulative_gap(c: Context) -> DataFrame:
    """Monthly orders are no running total."""
    return qc.monotone_cumulative(c.cohort_monthly_core, "cohort_year_month", "month_n", "cohort_order_cnt")


@query("month0_invariants")
def _month0_invariants(c: Context) -> DataFrame:
    return qc.month0_invariants(c.cohort_monthly_core)


@query("month0_invariants_gap")
def _month0_invariants_gap(c: Context) -> DataFrame:
    """Rows one month late: every cohort breaks the rules of its first month."""
    late = c.cohort_monthly_core.withColumn("month_n", F.col("month_n") - 1)
    return qc.month0_invariants(late)


@query("last_cumulative_equals_total")
def _last_cumulative_equals_total(c: Context) -> DataFrame:
    return qc.last_cumulative_equals_total(
        c.cohort_monthly_core, "cohort_year_month", "month_n", "cum_gross_revenue", "cohort_gross_revenue"
    )


@query("last_cumulative_equals_total_gap")
def _last_cumulative_equals_total_gap(c: Context) -> DataFrame:
    """Cohort size against all buyer-months: differs for every cohort that comes back."""
    return qc.last_cumulative_equals_total(
        c.cohort_monthly_core, "cohort_year_month", "month_n", "cohort_size", "cohort_active_buyers"
    )


@query("cohort_order_history")
def _cohort_order_history(c: Context) -> DataFrame:
    return marts.cohort_order_history(
        c.vw_customer_first_purchase_month, c.vw_delivered_orders, c.dim_customer, ["1995-01", "1995-03"]
    )


@query("calendar_boundary_checks")
def _calendar_boundary_checks(c: Context) -> DataFrame:
    return qc.calendar_boundary_checks(c.dim_date)
