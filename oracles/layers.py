"""Oracle SELECTs for sources, sinks, staging, star schema, KPIs and cohorts."""

from oracles.sqltext import clean, flag, n, pct, ratio, ts, union
from oracles.tables.analysis import CANCEL_COUNTS, CANCEL_RATES, MONEY, MONTHS_BETWEEN
from oracles.tables.marts import DATE_KEY
from tradewinds.sources.schemas import RAW_SCHEMAS, TABLE_SCHEMAS

# the names that these queries give to the tables
SQL_NAMES = {t: t for t in TABLE_SCHEMAS} | {
    "base_customer_monthly_purchase": "base",
    "kpi_monthly_core": "kpi_core",
    "kpi_monthly_cancellation": "kpi_cancel",
    "cohort_monthly_core": "cohort_core",
}

PRODUCT_COLUMNS = {
    "product_id": "string",
    "product_category_name": "string",
    "product_category_name_en": "string",
    "product_name_length": "int",
    "product_description_length": "int",
    "product_photos_qty": "int",
    "product_weight_g": "int",
    "product_length_cm": "int",
    "product_height_cm": "int",
    "product_width_cm": "int",
    "product_volume_cm3": "bigint",
    "is_category_blank": "int",
    "is_category_en_unmapped": "int",
    "is_weight_zero": "int",
}
# Columns whose values cannot be missing by their formula.
NEVER_NULL = {"is_category_blank", "is_category_en_unmapped", "is_weight_zero"}

DATE_COLUMNS = """SELECT {key} AS date_key, d AS "date", CAST(year(d) AS INTEGER) AS "year",
       CAST(quarter(d) AS INTEGER) AS "quarter", CAST(month(d) AS INTEGER) AS "month", CAST(day(d) AS INTEGER) AS "day",
       strftime(d, '%Y-%m') AS year_month, year(d) || '-Q' || quarter(d) AS year_quarter,
       CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(isodow(d) AS INTEGER) AS day_of_week, dayname(d) AS day_name,
       {weekend} AS is_weekend, {start} AS is_month_start, {end} AS is_month_end""".format(
    key=DATE_KEY.format(d="d"),
    weekend=flag("isodow(d) >= 6"),
    start=flag("day(d) = 1"),
    end=flag("d = last_day(d)"),
)


MONTH_OF_KEY = "order_purchase_date_key // 10000 || '-' || lpad(CAST(order_purchase_date_key // 100 % 100 AS VARCHAR), 2, '0')"


def _copy(name: str) -> str:
    return f"SELECT * FROM {name}"


def _damaged(name: str, key: str) -> str:
    """Records with a field too few or too many, as text."""
    columns = RAW_SCHEMAS[name].names
    fields = ", ".join(f"'\"' || replace(coalesce(CAST({c} AS VARCHAR), ''), '\"', '\"\"') || '\"'" for c in columns)
    few = f"CAST({key} AS BIGINT) % 13 = 1"
    return f"""SELECT '{name}' AS table_name, CAST(len(f) AS INTEGER) AS n_fields,
       CASE WHEN len(f) < {len(columns)} THEN 'too few fields' ELSE 'too many fields' END AS reason,
       array_to_string(f, ',') AS record, TRUE AS has_position
FROM (SELECT CASE WHEN {few} THEN [{fields}][:{len(columns) - 1}] ELSE list_append([{fields}], 'more') END AS f
      FROM raw_{name} WHERE CAST({key} AS BIGINT) % 13 IN (1, 2)) AS damaged"""


def _pivot(value: str, suffix: str, reduce: str, kind: str, fill: str | None = None) -> str:
    def cell(k: int) -> str:
        out = f"{reduce}({value}) FILTER (WHERE month_n = {k})"
        return f"CAST({out if fill is None else f'coalesce({out}, {fill})'} AS {kind}) AS m{k}_{suffix}"

    cells = ", ".join(cell(k) for k in range(13))
    return f"SELECT cohort_year_month, max(cohort_size) AS cohort_size, {cells} FROM cohort_core GROUP BY cohort_year_month"


def _trend(label: str, per_year: int) -> str:
    return f"""
SELECT period, gross_revenue, {_growth('g1', 'p1')} AS growth_vs_previous, {_growth('g2', 'p2')} AS growth_vs_last_year
FROM (SELECT *, cents - p1 AS g1, cents - p2 AS g2 FROM (
  SELECT period, gross_revenue, CAST(gross_revenue * 100 AS HUGEINT) AS cents,
         lag(CAST(gross_revenue * 100 AS HUGEINT), 1) OVER (ORDER BY period) AS p1,
         lag(CAST(gross_revenue * 100 AS HUGEINT), {per_year}) OVER (ORDER BY period) AS p2
  FROM (SELECT {label} AS period, CAST(sum(gross_revenue) AS {MONEY}) AS gross_revenue FROM kpi_core GROUP BY 1) AS t) AS u) AS v"""


def _growth(change: str, before: str) -> str:
    return ratio(change, before, 6, "DECIMAL(18,6)")


def _breakdown(label: str, source: str) -> str:
    return f"SELECT {label}, {CANCEL_RATES}, total_orders, canceled_orders, unavailable_orders, failed_orders FROM (SELECT {label}, {CANCEL_COUNTS} FROM {source} GROUP BY {label}) AS t"


def _sales(group: str) -> str:
    lead = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return f"""
SELECT {lead}gross_revenue, item_cnt, order_cnt, {ratio("gross_revenue", "valued", 2, MONEY, 2)} AS avg_item_total,
       {ratio("freight", "freighted", 2, MONEY, 2)} AS avg_freight
FROM (SELECT {lead}CAST(sum(item_total_value) AS {MONEY}) AS gross_revenue, count(*) AS item_cnt,
             count(DISTINCT order_id) AS order_cnt, count(item_total_value) AS valued,
             CAST(sum(freight_value) AS {MONEY}) AS freight, count(freight_value) AS freighted
      FROM delivered_items{tail}) AS t"""


def _operations(group: str, source: str) -> str:
    lead = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return f"""
SELECT {lead}order_cnt, {ratio("canceled", "order_cnt")} AS cancel_rate, {ratio("delivered", "order_cnt")} AS completion_rate,
       {ratio("approve_days", "approved", 2, MONEY)} AS avg_approve_lead_days,
       {ratio("delivery_days", "timed", 2, MONEY)} AS avg_delivery_lead_days, {ratio("late", "order_cnt")} AS late_rate
FROM (SELECT {lead}count(*) AS order_cnt, CAST(sum(is_canceled) AS BIGINT) AS canceled, CAST(sum(is_delivered) AS BIGINT) AS delivered,
             CAST(sum(approve_lead_days) AS BIGINT) AS approve_days, count(approve_lead_days) AS approved,
             CAST(sum(delivery_lead_days) AS BIGINT) AS delivery_days, count(delivery_lead_days) AS timed,
             {n("delivery_delay_days > 0")} AS late
      FROM {source}{tail}) AS t"""


QUERIES = {
    # sources and sinks
    "raw_orders": _copy("raw_orders"),
    "raw_order_items": _copy("raw_order_items"),
    "raw_order_payments": _copy("raw_order_payments"),
    "raw_order_reviews": _copy("raw_order_reviews"),
    "raw_rejects": union([_damaged("order_reviews", "order_id"), _damaged("sellers", "seller_id")]),
    "raw_accepted": "SELECT * FROM raw_order_reviews WHERE CAST(order_id AS BIGINT) % 13 NOT IN (1, 2)",
    "raw_customers": _copy("raw_customers"),
    "raw_products": _copy("raw_products"),
    "raw_sellers": _copy("raw_sellers"),
    "raw_geolocation": _copy("raw_geolocation"),
    "raw_category_translation": _copy("raw_translation"),
    "blank_numeric_to_null": """
SELECT order_id, order_item_id, CASE WHEN NOT regexp_matches(product_id, '[37]$') THEN price END AS price,
       CASE WHEN seller_id NOT LIKE '%9' THEN CAST(order_item_id AS INTEGER) END AS line_no
FROM raw_order_items""",
    "overwrite_table": _copy("stg_order_payments"),
    "register_view": """
SELECT year_month, count(*) AS order_cnt, min(delivery_lead_days) AS fastest FROM delivered_orders GROUP BY year_month""",
    "row_count_report": union(
        [
            f"SELECT '{label}' AS tbl, count(*) AS cnt FROM {table}"
            for label, table in {
                **{t: f"raw_{t}" for t in ("orders", "order_items", "order_payments", "order_reviews", "customers")},
                **{t: f"raw_{t}" for t in ("products", "sellers", "geolocation")},
                "category_translation": "raw_translation",
                **SQL_NAMES,
            }.items()
        ]
    ),
    "sample_rows": """
SELECT order_id, order_item_id, product_id, item_total_value FROM stg_order_items
ORDER BY item_total_value DESC NULLS LAST, order_id, order_item_id, product_id LIMIT 50""",
    "schema_report": union(
        [
            f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS column_name, '{t}' AS data_type, "
            f"{str(c not in NEVER_NULL).lower()} AS is_nullable, count({c}) AS present_cnt FROM stg_products"
            for i, (c, t) in enumerate(PRODUCT_COLUMNS.items(), start=1)
        ]
    ),
    "schema_report_all": union(
        [
            f"SELECT '{table}' AS table_name, CAST({i} AS INTEGER) AS ordinal, '{f.name}' AS column_name, "
            f"'{f.dataType.simpleString()}' AS data_type, count(\"{f.name}\") AS present_cnt FROM {SQL_NAMES[table]}"
            for table, schema in TABLE_SCHEMAS.items()
            for i, f in enumerate(schema.fields, start=1)
        ]
    ),
    "fact_orders_of_month": f"SELECT *, {MONTH_OF_KEY} AS year_month FROM fact_orders",
    "overwrite_partitions": f"""
SELECT * REPLACE (CAST(CASE WHEN {MONTH_OF_KEY} LIKE '%3' THEN 9 ELSE is_canceled END AS INTEGER) AS is_canceled),
       {MONTH_OF_KEY} AS year_month FROM fact_orders""",
    # staging
    **{
        t: _copy(t)
        for t in (
            "stg_orders",
            "stg_customers",
            "stg_order_items",
            "stg_products",
            "stg_sellers",
            "stg_order_payments",
            "stg_order_reviews",
            "stg_geolocation",
        )
    },
    "clean_text": f"""
SELECT review_id, {clean("review_comment_title")} AS title_kept, {clean("review_comment_title", "upper", True)} AS title_upper,
       {clean("review_comment_message", "lower", True)} AS message_lower, trim(review_comment_message) AS message_with_cr
FROM raw_order_reviews""",
    "parse_ts": f"""
SELECT order_id, {ts("order_purchase_timestamp")} AS order_purchase_timestamp, {ts("order_approved_at")} AS order_approved_at,
       {ts("order_delivered_customer_date")} AS order_delivered_customer_date FROM raw_orders""",
    "calendar_parts": """
SELECT order_id, order_purchase_date AS order_date, order_year, order_month, order_year_month FROM stg_orders""",
    "approve_lead_days": "SELECT order_id, approve_lead_days FROM stg_orders",
    "delivery_lead_days": "SELECT order_id, delivery_lead_days FROM stg_orders",
    "delivery_delay_days": "SELECT order_id, delivery_delay_days FROM stg_orders",
    "delivered_canceled_flags": "SELECT order_id, is_delivered, is_canceled FROM stg_orders",
    "is_time_inconsistent": "SELECT order_id, is_time_inconsistent FROM stg_orders",
    "is_status_inconsistent": "SELECT order_id, is_status_inconsistent FROM stg_orders",
    "is_carrier_dt_missing": "SELECT order_id, is_carrier_dt_missing FROM stg_orders",
    "lookup_translate": f"""
SELECT product_id, product_category_name, product_category_name_en AS category_en,
       {flag("product_category_name IS NOT NULL AND is_category_en_unmapped = 0")} AS is_translated FROM stg_products""",
    "volume_cm3": "SELECT product_id, product_volume_cm3 FROM stg_products",
    "product_flags": "SELECT product_id, is_category_blank, is_category_en_unmapped, is_weight_zero FROM stg_products",
    "geo_valid_flag": "SELECT zip_prefix, is_valid, count(*) AS cnt FROM geo_points GROUP BY zip_prefix, is_valid",
    "geo_zip_agg": _copy("geo_counts"),
    "mode_by_key_point": _copy("point_mode"),
    "mode_by_key_place": _copy("place_mode"),
    "mode_by_key_collated": """
SELECT zip_prefix, city, state, place_cnt FROM (
  SELECT zip_prefix, min(city) AS city, min(state) AS state, count(*) AS place_cnt,
         row_number() OVER (PARTITION BY zip_prefix ORDER BY count(*) DESC, min(city), min(state)) AS place
  FROM (SELECT geolocation_zip_code_prefix AS zip_prefix, replace(geolocation_city, chr(13), '') AS city, geolocation_state AS state
        FROM raw_geolocation) AS g GROUP BY zip_prefix, lower(city), lower(state)) AS r WHERE place = 1""",
    "stg_geolocation_collated": f"""
SELECT * FROM (
  SELECT zip_prefix AS geolocation_zip_code_prefix, lat AS geolocation_lat, lng AS geolocation_lng,
         city AS geolocation_city, state AS geolocation_state, city || '_' || state AS geolocation_city_state,
         row_cnt, coalesce(mode_cnt, 0) AS mode_cnt, {pct("coalesce(mode_cnt, 0)", "row_cnt")} AS mode_ratio_pct,
         invalid_latlng_cnt, city_cnt, state_cnt, {flag("invalid_latlng_cnt > 0")} AS is_invalid_latlng_exists,
         {flag("city_cnt > 1")} AS is_multi_city, {flag("state_cnt > 1")} AS is_multi_state
  FROM (
    SELECT zip_prefix, count(*) AS row_cnt, count(*) FILTER (WHERE is_valid = 0) AS invalid_latlng_cnt,
           count(DISTINCT strip_accents(lower(city))) AS city_cnt, count(DISTINCT strip_accents(lower(state))) AS state_cnt
    FROM accented GROUP BY zip_prefix) AS counts
  LEFT JOIN point_mode USING (zip_prefix)
  LEFT JOIN (
    SELECT zip_prefix, min(city) AS city, min(state) AS state,
           row_number() OVER (PARTITION BY zip_prefix ORDER BY count(*) DESC, min(city), min(state)) AS place
    FROM accented GROUP BY zip_prefix, strip_accents(lower(city)), strip_accents(lower(state))) AS places USING (zip_prefix)
  WHERE place = 1) AS t""",
    "geo_assemble": _copy("stg_geolocation"),
    # star schema
    "dim_date": _copy("dim_date"),
    "dim_geolocation": _copy("dim_geolocation"),
    "dim_customer": _copy("dim_customer"),
    "dim_product": _copy("dim_product"),
    "dim_seller": _copy("dim_seller"),
    "fact_order_items": _copy("fact_order_items"),
    "fact_orders": _copy("fact_orders"),
    "vw_delivered_orders": _copy("delivered_orders"),
    "vw_delivered_order_items": _copy("delivered_items"),
    "vw_customer_first_purchase_month": _copy("first_purchase"),
    "date_bounds": _copy("bounds"),
    "generate_calendar": _copy("days"),
    "calendar_attributes": f"{DATE_COLUMNS} FROM (SELECT DISTINCT order_purchase_date AS d FROM stg_orders) AS t",
    # KPIs and cohorts
    "base_customer_monthly_purchase": _copy("base"),
    "kpi_monthly_core": _copy("kpi_core"),
    "kpi_monthly_cancellation": _copy("kpi_cancel"),
    "cohort_monthly_core": _copy("cohort_core"),
    "cohort_pivot_buyers": _pivot("cohort_active_buyers", "buyers", "sum", "BIGINT"),
    "cohort_pivot_orders": _pivot("cohort_order_cnt", "orders", "sum", "BIGINT", "0"),
    "cohort_pivot_revenue": _pivot("cohort_gross_revenue", "revenue", "sum", MONEY, "0"),
    "cohort_pivot_retention": _pivot("cohort_retention_rate", "retention", "max", "DECIMAL(18,6)"),
    "cohort_pivot_aov": _pivot("cohort_aov", "aov", "max", MONEY),
    "base_orders": _copy("person_orders"),
    "base_items": _copy("person_items"),
    "month_offset": f"""
SELECT order_id, {MONTHS_BETWEEN.format(a="bought", b="due")} AS months_to_due,
       {MONTHS_BETWEEN.format(a="bought", b="shipped_in")} AS months_to_shipping
FROM (SELECT order_id, strftime(order_purchase_dt, '%Y-%m') AS bought, strftime(order_estimated_delivery_dt, '%Y-%m') AS due,
             strftime(order_delivered_carrier_dt, '%Y-%m') AS shipped_in FROM stg_orders) AS t""",
    "new_repeat_flags": "SELECT customer_unique_id, year_month, is_active, is_new_buyer, is_repeat_buyer FROM base",
    "dense_months": _copy("months"),
    "safe_ratio": f"""
SELECT order_id, {ratio("paid", "installments", 2, MONEY, 2)} AS per_installment
FROM (SELECT order_id, sum(payment_value) AS paid, CAST(sum(payment_installments) AS BIGINT) AS installments
      FROM stg_order_payments GROUP BY order_id) AS t""",
    "conditional_distinct": """
SELECT seller_id, count(DISTINCT product_id) AS products, count(DISTINCT product_id) FILTER (WHERE price > 30000) AS dear_products,
       count(DISTINCT product_id) FILTER (WHERE order_item_seq = 1) AS first_line_products
FROM stg_order_items GROUP BY seller_id""",
    "cohort_matrix": _copy("cohort_grid"),
    "cohort_base_agg": _copy("cohort_values"),
    "cohort_size": _copy("cohort_sizes"),
    "cohort_retention_aov": "SELECT cohort_year_month, month_n, cohort_retention_rate, cohort_aov FROM cohort_core",
    "cohort_cumulative": f"""
SELECT cohort_year_month, month_n,
       CAST(sum(cohort_gross_revenue) OVER (PARTITION BY cohort_year_month ORDER BY month_n) AS {MONEY}) AS cum_gross_revenue,
       CAST(sum(cohort_order_cnt) OVER (PARTITION BY cohort_year_month ORDER BY month_n) AS BIGINT) AS cum_order_cnt
FROM cohort_values""",
    "kpi_sales_summary": _sales(""),
    "kpi_sales_summary_monthly": _sales("year_month"),
    "revenue_by_category": f"""
SELECT product_category_name, CAST(sum(item_total_value) AS {MONEY}) AS gross_revenue, count(*) AS item_cnt
FROM delivered_items AS i LEFT JOIN dim_product AS p ON p.product_id = i.product_id GROUP BY product_category_name""",
    "revenue_by_customer_region": f"""
SELECT geolocation_city_state AS city_state, CAST(sum(item_total_value) AS {MONEY}) AS gross_revenue, count(*) AS item_cnt
FROM delivered_items LEFT JOIN dim_geolocation ON geolocation_zip_code_prefix = customer_zip_code_prefix GROUP BY 1""",
    "revenue_by_seller_region": f"""
SELECT geolocation_city_state AS city_state, CAST(sum(item_total_value) AS {MONEY}) AS gross_revenue, count(*) AS item_cnt
FROM delivered_items LEFT JOIN dim_geolocation ON geolocation_zip_code_prefix = seller_zip_code_prefix GROUP BY 1""",
    "kpi_operations_summary": _operations("", "fact_orders"),
    "kpi_operations_summary_monthly": _operations(
        "year_month", "(SELECT *, strftime(order_purchase_dt, '%Y-%m') AS year_month FROM fact_orders) AS f"
    ),
    "overall_repeat_rate": f"""
SELECT buyers, repeat_buyers, {ratio("repeat_buyers", "buyers")} AS repeat_rate
FROM (SELECT count(*) AS buyers, {n("orders_of_person >= 2")} AS repeat_buyers
      FROM (SELECT sum(order_cnt) AS orders_of_person FROM base GROUP BY customer_unique_id) AS p) AS t""",
    "revenue_trend_month": _trend("year_month", 12),
    "revenue_trend_quarter": _trend(
        "substring(year_month, 1, 4) || '-Q' || quarter(CAST(year_month || '-01' AS DATE))", 4
    ),
    "revenue_trend_year": _trend("substring(year_month, 1, 4)", 1),
    "cancellation_by_category": _breakdown(
        "product_category_name",
        """(SELECT o.order_id, order_status, product_category_name FROM fact_order_items AS i
            JOIN fact_orders AS o ON o.order_id = i.order_id LEFT JOIN dim_product AS p ON p.product_id = i.product_id) AS x""",
    ),
    "cancellation_by_seller": _breakdown(
        "seller_id",
        """(SELECT o.order_id, order_status, seller_id FROM fact_order_items AS i JOIN fact_orders AS o ON o.order_id = i.order_id) AS x""",
    ),
    "cancellation_by_region": _breakdown(
        "city_state",
        """(SELECT order_id, order_status, geolocation_city_state AS city_state FROM fact_orders
            LEFT JOIN dim_geolocation ON geolocation_zip_code_prefix = customer_zip_code_prefix) AS x""",
    ),
    "dense_customer_month": f"""
SELECT p.customer_unique_id, m.year_month, p.cohort_year_month,
       {MONTHS_BETWEEN.format(a="p.cohort_year_month", b="m.year_month")} AS month_n, coalesce(order_cnt, 0) AS order_cnt,
       coalesce(item_cnt, 0) AS item_cnt, CAST(coalesce(gross_revenue, 0) AS {MONEY}) AS gross_revenue,
       {flag("order_cnt > 0")} AS is_active
FROM (SELECT DISTINCT customer_unique_id, cohort_year_month FROM base) AS p JOIN months AS m ON m.year_month >= p.cohort_year_month
LEFT JOIN base AS b ON b.customer_unique_id = p.customer_unique_id AND b.year_month = m.year_month""",
    "join_integrity_flags": f"""
SELECT order_id, {flag("order_id NOT IN (SELECT order_id FROM stg_order_items)")} AS is_without_items,
       {flag("order_id NOT IN (SELECT order_id FROM stg_order_payments)")} AS is_without_payments,
       {flag("first_review < order_purchase_dt")} AS is_reviewed_before_purchase
FROM stg_orders LEFT JOIN (SELECT order_id, min(review_creation_dt) AS first_review FROM stg_order_reviews GROUP BY order_id) AS r USING (order_id)""",
    "orders_vs_aov_decomposition": f"""
SELECT year_month, CAST(gross_revenue - revenue0 AS {MONEY}) AS revenue_change, order_effect,
       CAST(gross_revenue - revenue0 - order_effect AS {MONEY}) AS aov_effect
FROM (SELECT *, {ratio("(order_cnt - orders0) * cents0", "100 * orders0", 2, MONEY)} AS order_effect
  FROM (SELECT year_month, gross_revenue, order_cnt, lag(gross_revenue) OVER (ORDER BY year_month) AS revenue0,
               lag(CAST(gross_revenue * 100 AS HUGEINT)) OVER (ORDER BY year_month) AS cents0,
               lag(CAST(order_cnt AS HUGEINT)) OVER (ORDER BY year_month) AS orders0 FROM kpi_core) AS t) AS u""",
}
