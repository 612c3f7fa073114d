"""Oracle SELECTs for the data-quality queries."""

from oracles.sqltext import clean, flag, n, pct, ratio, ts, union
from oracles.tables.analysis import MONEY

NUM = "DECIMAL(20,6)"
ZIP = "geolocation_zip_code_prefix"

KEYS = {
    "stg_orders": ["order_id"],
    "stg_customers": ["customer_id"],
    "stg_order_items": ["order_id", "order_item_id"],
    "stg_products": ["product_id"],
    "stg_sellers": ["seller_id"],
    "stg_order_payments": ["order_id", "payment_sequential"],
    "stg_order_reviews": ["review_id", "order_id"],
    "stg_geolocation": [ZIP],
}

CRITICAL = {
    "stg_orders": ("customer_id, order_purchase_dt, order_status", "order_status"),
    "stg_customers": ("customer_unique_id, customer_zip_code_prefix, customer_city_state", "customer_city_state"),
    "stg_order_items": ("product_id, seller_id, price, freight_value", None),
    "stg_sellers": ("seller_zip_code_prefix, seller_city_state", "seller_city_state"),
    "stg_order_payments": ("payment_value, payment_type", "payment_type"),
    "stg_order_reviews": ("review_score", None),
}

FLAGS = {
    "stg_orders": [
        "is_delivered",
        "is_canceled",
        "is_time_inconsistent",
        "is_status_inconsistent",
        "is_carrier_dt_missing",
    ],
    "stg_products": ["is_category_blank", "is_category_en_unmapped", "is_weight_zero"],
    "stg_order_payments": ["is_installments_zero", "is_payment_value_zero"],
    "stg_order_reviews": ["is_title_blank", "is_message_blank"],
    "stg_geolocation": ["is_invalid_latlng_exists", "is_multi_city", "is_multi_state"],
}

DOMAINS = [
    (
        "stg_order_payments",
        "payment_type_domain",
        "trim(payment_type) <> '' AND payment_type NOT IN ('credit_card', 'boleto', 'voucher', 'debit_card', 'not_defined')",
    ),
    ("stg_order_payments", "payment_sequential >= 1", "payment_sequential < 1"),
    ("stg_order_payments", "payment_installments >= 0", "payment_installments < 0"),
    ("stg_order_payments", "payment_value >= 0", "payment_value < 0"),
    ("stg_order_reviews", "review_score BETWEEN 1 AND 5", "review_score < 1 OR review_score > 5"),
    ("stg_order_items", "price >= 0 AND freight_value >= 0", "price < 0 OR freight_value < 0"),
    ("stg_geolocation", "lat in range", "geolocation_lat < -35 OR geolocation_lat > 6"),
    ("stg_geolocation", "lng in range", "geolocation_lng < -75 OR geolocation_lng > -30"),
]

REFERENCES = [
    ("orders.customer_id -> customers", "stg_orders", "customer_id", "stg_customers", "customer_id"),
    ("order_items.order_id -> orders", "stg_order_items", "order_id", "stg_orders", "order_id"),
    ("order_items.product_id -> products", "stg_order_items", "product_id", "stg_products", "product_id"),
    ("order_items.seller_id -> sellers", "stg_order_items", "seller_id", "stg_sellers", "seller_id"),
    ("order_payments.order_id -> orders", "stg_order_payments", "order_id", "stg_orders", "order_id"),
    ("order_reviews.order_id -> orders", "stg_order_reviews", "order_id", "stg_orders", "order_id"),
    ("customers.zip -> geolocation", "stg_customers", "customer_zip_code_prefix", "stg_geolocation", ZIP),
    ("sellers.zip -> geolocation", "stg_sellers", "seller_zip_code_prefix", "stg_geolocation", ZIP),
]

RAW = {
    "orders": "stg_orders",
    "customers": "stg_customers",
    "order_items": "stg_order_items",
    "products": "stg_products",
    "sellers": "stg_sellers",
    "order_payments": "stg_order_payments",
    "order_reviews": "stg_order_reviews",
}


def label(keys: list[str]) -> str:
    return keys[0] if len(keys) == 1 else f"({', '.join(keys)})"


def profile(table: str, keys: list[str]) -> str:
    whole = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    blank = f"{keys[0]} IS NULL OR {keys[0]} = ''" if len(keys) == 1 else f"NOT ({whole})"
    distinct = f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM {table} WHERE {whole}) AS d)"
    return f"""SELECT count(*) AS cnt, {distinct} AS distinct_cnt, count(*) - {distinct} AS dup_cnt,
    {n(blank)} AS blank_cnt FROM {table}"""


def duplicates(table: str, keys: list[str]) -> str:
    group = ", ".join(keys)
    return f"SELECT count(*) AS dup_cnt FROM (SELECT {group} FROM {table} GROUP BY {group} HAVING count(*) > 1) AS t"


def uniqueness() -> str:
    return union(
        [
            f"""SELECT '{t}' AS table_name, '{label(k)}' AS pk_cols, count(*) - (SELECT count(*) FROM
            (SELECT DISTINCT {", ".join(k)} FROM {t}) AS d) AS dup_cnt FROM {t}"""
            for t, k in KEYS.items()
        ]
    )


def key_nulls() -> str:
    return union(
        [
            f"SELECT '{t}' AS table_name, '{label(k)}' AS pk_cols, {n(' OR '.join(f'{c} IS NULL' for c in k))} AS pk_null_cnt FROM {t}"
            for t, k in KEYS.items()
        ]
    )


def critical() -> str:
    parts = []
    for t, (columns, blankable) in CRITICAL.items():
        counts = [
            n(f"{c} IS NULL OR trim({c}) = ''" if c == blankable else f"{c} IS NULL") for c in columns.split(", ")
        ]
        parts.append(
            f"SELECT '{t}' AS table_name, '{columns}' AS critical_cols, {' + '.join(counts)} AS critical_null_cnt FROM {t}"
        )
    return union(parts)


def flag_rates() -> str:
    return union(
        [
            f"""SELECT '{t}' AS table_name, '{f}' AS flag_col, count(*) AS total_cnt, {n(f"{f} IS NULL")} AS null_cnt,
            {n(f"{f} NOT IN (0, 1)")} AS invalid_value_cnt, {pct(n(f"{f} = 1"), "count(*)")} AS true_rate_pct FROM {t}"""
            for t, flags in FLAGS.items()
            for f in flags
        ]
    )


def domain_counts() -> str:
    return union(
        [f"SELECT '{t}' AS table_name, '{r}' AS rule_name, {n(bad)} AS invalid_cnt FROM {t}" for t, r, bad in DOMAINS]
    )


def orphans(child: str, ck: str, parent: str, pk: str) -> str:
    return f"FROM {child} AS c WHERE c.{ck} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} AS p WHERE p.{pk} = c.{ck})"


def reference_counts() -> str:
    return union(
        [
            f"SELECT '{child}' AS table_name, '{rule}' AS rule_name, count(*) AS orphan_cnt {orphans(child, ck, parent, pk)}"
            for rule, child, ck, parent, pk in REFERENCES
        ]
    )


def layer_counts() -> str:
    parts = [(entity, f"(SELECT count(*) FROM raw_{entity})", stg) for entity, stg in RAW.items()]
    parts.append(("geolocation_zips", "(SELECT count(DISTINCT trim(geolocation_zip_code_prefix)) FROM raw_geolocation)", "stg_geolocation"))
    return union(
        [
            f"SELECT '{e}' AS entity, {src} AS source_cnt, count(*) AS target_cnt, count(*) - {src} AS diff FROM {stg}"
            for e, src, stg in parts
        ]
    )


def long_nulls(table: str, columns: list[str], text: str = "{c}", textual: bool = True) -> str:
    parts = []
    for c in columns:
        blank = n(f"{text.format(c=c)} = ''") if textual else "CAST(0 AS BIGINT)"
        parts.append(
            f"SELECT '{c}' AS column_name, {n(f'{c} IS NULL')} AS null_cnt, {blank} AS blank_cnt, "
            f"{n(f'{c} IS NULL')} + {blank} AS missing_cnt FROM {table}"
        )
    return union(parts)


def numbers(table: str, columns: list[str]) -> str:
    return union(
        [
            f"""SELECT '{c}' AS column_name, {n(f"{c} IS NULL")} AS null_cnt, {n(f"{c} < 0")} AS negative_cnt,
            {n(f"{c} = 0")} AS zero_cnt, CAST(min({c}) AS {NUM}) AS min_value, CAST(max({c}) AS {NUM}) AS max_value FROM {table}"""
            for c in columns
        ]
    )


def kpi_ranges(table: str, columns: list[str]) -> str:
    return union(
        [
            f"""SELECT '{c}' AS kpi, {n(f"{c} = 0")} AS zero_cnt, {n(f"{c} < 0")} AS negative_cnt,
            CAST(min({c}) AS {NUM}) AS min_value, CAST(max({c}) AS {NUM}) AS max_value FROM {table}"""
            for c in columns
        ]
    )


def negatives(table: str, columns: list[str]) -> str:
    return union([f"SELECT '{c}' AS column_name, {n(f'{c} < 0')} AS negative_cnt FROM {table}" for c in columns])


def violations(table: str, rules: dict[str, str]) -> str:
    return union([f"SELECT '{r}' AS rule_name, {n(c)} AS violation_cnt FROM {table}" for r, c in rules.items()])


def share(value: str, name: str, table: str) -> str:
    return f"""SELECT {name}, cnt, {pct("cnt", "total")} AS cnt_pct
FROM (SELECT {value} AS {name}, count(*) AS cnt, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM {table} GROUP BY 1) AS t"""


def shape(table: str, column: str, size: int) -> str:
    return f"""SELECT CAST(min(strlen(t)) AS INTEGER) AS min_len, CAST(max(strlen(t)) AS INTEGER) AS max_len,
       {n("NOT regexp_full_match(t, '[0-9]+')")} AS non_numeric_cnt, {n(f"strlen(t) <> {size}")} AS wrong_len_cnt
FROM (SELECT {clean(column, "", True)} AS t FROM {table}) AS x"""


def early(child: str, child_ts: str, parent_ts: str) -> str:
    return f"""(SELECT c.order_id, date_sub('minute', p.{parent_ts}, c.{child_ts}) AS gap FROM {child} AS c
  JOIN stg_orders AS p ON p.order_id = c.order_id WHERE c.{child_ts} < p.{parent_ts}) AS early_rows"""


def event_order(child: str, child_ts: str, parent_ts: str) -> str:
    return f"""SELECT count(*) AS early_cnt, count(DISTINCT order_id) AS early_key_cnt, min(gap) AS min_gap_min, max(gap) AS max_gap_min
FROM {early(child, child_ts, parent_ts)}"""


def coverage(child: str, ck: str, parent: str, pk: str) -> str:
    return f"""SELECT row_cnt, unmatched_cnt, {pct("row_cnt - unmatched_cnt", "row_cnt")} AS coverage_pct,
       {pct("unmatched_cnt", "row_cnt")} AS unmatched_pct
FROM (SELECT count(*) AS row_cnt, {n(f"{ck} NOT IN (SELECT {pk} FROM {parent})")} AS unmatched_cnt
      FROM {child} WHERE {ck} IS NOT NULL) AS t"""


def mismatches(a: str, b: str, key: str, columns: list[str]) -> str:
    diff = {c: f"a.{c} IS DISTINCT FROM b.{c}" for c in columns}
    each = ", ".join(f"{n(d)} AS {c}_diff_cnt" for c, d in diff.items())
    some = n(" OR ".join(diff.values()))
    return f"SELECT {some} AS mismatch_cnt, {each} FROM {a} AS a JOIN {b} AS b ON a.{key} = b.{key}"


def totals(rows: dict[str, tuple[str, str, str, str]]) -> str:
    return union(
        [
            f"""SELECT '{m}' AS measure, CAST(a AS DECIMAL(20,2)) AS left_total, CAST(b AS DECIMAL(20,2)) AS right_total,
            CAST(a - b AS DECIMAL(20,2)) AS diff
            FROM (SELECT (SELECT {la} FROM {lt}) AS a, (SELECT {ra} FROM {rt}) AS b) AS t"""
            for m, (lt, la, rt, ra) in rows.items()
        ]
    )


def month0(cohorts: str) -> str:
    return union(
        [
            f"SELECT cohort_year_month, year_month, month_n, '{r}' AS rule_name FROM {cohorts} AS t WHERE {c}"
            for r, c in {
                "month_before_cohort": "year_month < cohort_year_month",
                "month0_active_is_size": "month_n = 0 AND cohort_active_buyers <> cohort_size",
                "no_buyers_no_measures": "cohort_active_buyers = 0 AND (cohort_order_cnt <> 0 OR cohort_gross_revenue <> 0)",
                "month0_cumulative_revenue": "month_n = 0 AND cum_gross_revenue <> cohort_gross_revenue",
                "month0_cumulative_orders": "month_n = 0 AND cum_order_cnt <> cohort_order_cnt",
            }.items()
        ]
    )


def _section(sql: str, section: str, subject: str, check: str, value: str, severity: str) -> str:
    return f"""SELECT '{section}' AS section, {subject} AS subject, {check} AS check_name, {severity} AS severity,
    CAST({value} AS DECIMAL(20,2)) AS value FROM ({sql}) AS s"""


def report() -> str:
    watched = "CASE WHEN rule_name IN ('customers.zip -> geolocation', 'sellers.zip -> geolocation') THEN 'monitor' ELSE 'fail' END"
    rows = union(
        [
            _section(layer_counts(), "row counts", "entity", "'staging - raw'", "diff", "'monitor'"),
            _section(uniqueness(), "keys", "table_name", "'repeated ' || pk_cols", "dup_cnt", "'fail'"),
            _section(key_nulls(), "keys", "table_name", "'missing ' || pk_cols", "pk_null_cnt", "'fail'"),
            _section(critical(), "critical columns", "table_name", "critical_cols", "critical_null_cnt", "'fail'"),
            _section(flag_rates(), "flags", "table_name", "flag_col", "true_rate_pct", "'monitor'"),
            _section(domain_counts(), "domains", "table_name", "rule_name", "invalid_cnt", "'fail'"),
            _section(reference_counts(), "references", "table_name", "rule_name", "orphan_cnt", watched),
        ]
    )
    return f"SELECT *, severity = 'monitor' OR coalesce(value = 0, false) AS passed FROM ({rows}) AS r"


QUERIES = {
    # keys
    "unique_key_profile": profile("raw_orders", ["order_id"]),
    "unique_key_profile_customer": profile("raw_customers", ["customer_unique_id"]),
    "duplicate_key_groups": duplicates("raw_order_items", ["order_id", "order_item_id"]),
    "duplicate_key_groups_points": duplicates("raw_geolocation", [ZIP, "geolocation_lat", "geolocation_lng"]),
    "composite_unique_profile": profile("fact_order_items", ["order_id", "order_item_id"]),
    "composite_unique_profile_person_month": profile("base", ["customer_unique_id", "year_month"]),
    "pk_uniqueness_summary": uniqueness(),
    "pk_null_summary": key_nulls(),
    "critical_null_summary": critical(),
    "flag_snapshot": flag_rates(),
    "domain_range_rules": domain_counts(),
    "referential_summary": reference_counts(),
    "row_count_reconcile": layer_counts(),
    "run_qc": report(),
    # values
    "null_blank_counts": long_nulls(
        "raw_orders", ["order_id", "customer_id", "order_status", "order_approved_at", "order_delivered_customer_date"]
    ),
    "null_blank_counts_reviews": long_nulls(
        "raw_order_reviews", ["review_comment_title", "review_comment_message"], "trim(replace({c}, chr(13), ''))"
    ),
    "null_blank_counts_fact": union(
        [
            long_nulls("fact_order_items", ["order_purchase_date_key"], textual=False),
            long_nulls("fact_order_items", ["customer_id", "customer_zip_code_prefix", "seller_zip_code_prefix"]),
        ]
    ),
    "parse_failure_counts": union(
        [
            f"SELECT '{c}' AS column_name, {n(f'{clean(c)} <> {chr(39) * 2} AND {ts(c)} IS NULL')} AS parse_fail_cnt FROM raw_orders"
            for c in (
                "order_purchase_timestamp",
                "order_approved_at",
                "order_delivered_carrier_date",
                "order_delivered_customer_date",
                "order_estimated_delivery_date",
            )
        ]
    ),
    "value_distribution": f"SELECT {clean('order_status', 'lower')} AS order_status, count(*) AS cnt FROM raw_orders GROUP BY 1",
    "value_distribution_cohorts": "SELECT first_purchase_year_month AS year_month, count(*) AS cnt FROM first_purchase GROUP BY 1",
    "value_share": share(clean("geolocation_state", "upper"), "state", "raw_geolocation"),
    "value_share_payments": share("payment_type", "payment_type", "stg_order_payments"),
    "value_share_sellers": share("seller_city_state", "seller_city_state", "stg_sellers"),
    "numeric_profile": numbers("stg_order_items", ["price", "freight_value", "item_total_value", "order_item_seq"]),
    "numeric_profile_products": numbers(
        "stg_products",
        [
            f"product_{m}"
            for m in "name_length description_length photos_qty weight_g length_cm height_cm width_cm volume_cm3".split()
        ],
    ),
    "numeric_profile_payments": numbers(
        "raw_order_payments", ["payment_sequential", "payment_installments", "payment_value"]
    ),
    "count_of_counts": """SELECT group_size, count(*) AS key_cnt
FROM (SELECT count(*) AS group_size FROM raw_order_payments GROUP BY order_id) AS t GROUP BY group_size""",
    "count_of_counts_cities": f"""SELECT group_size, count(*) AS key_cnt
FROM (SELECT count(DISTINCT trim(upper(geolocation_city))) AS group_size FROM raw_geolocation GROUP BY {ZIP}) AS t GROUP BY group_size""",
    "top_n_groups": f"SELECT {ZIP}, count(*) AS cnt FROM raw_geolocation GROUP BY {ZIP} ORDER BY cnt DESC, {ZIP} LIMIT 20",
    "top_n_groups_spread": f"""
SELECT {ZIP}, count(*) AS row_cnt, count(DISTINCT (geolocation_lat, geolocation_lng)) AS distinct_point_cnt,
       CAST(max(geolocation_lat) - min(geolocation_lat) AS DECIMAL(11,6)) AS lat_range,
       CAST(max(geolocation_lng) - min(geolocation_lng) AS DECIMAL(11,6)) AS lng_range
FROM raw_geolocation GROUP BY {ZIP} ORDER BY lat_range DESC, lng_range DESC, {ZIP} LIMIT 20""",
    "string_shape": shape("raw_customers", "customer_zip_code_prefix", 5),
    "string_shape_state": shape("raw_customers", "customer_state", 2),
    "normalisation_effect": f"""SELECT count(DISTINCT geolocation_city) AS raw_distinct,
       count(DISTINCT {clean("geolocation_city", "lower")}) AS norm_distinct FROM raw_geolocation""",
    "normalisation_effect_pair": f"""SELECT count(DISTINCT geolocation_city || '_' || geolocation_state) AS raw_distinct,
       count(DISTINCT {clean("geolocation_city", "lower")} || '_' || {clean("geolocation_state", "upper")}) AS norm_distinct
FROM raw_geolocation""",
    "multi_mapped_keys": f"""SELECT {ZIP}, count(DISTINCT geolocation_state) AS value_cnt FROM raw_geolocation
GROUP BY {ZIP} HAVING count(DISTINCT geolocation_state) > 1""",
    "multi_mapped_values": f"""SELECT {ZIP}, geolocation_state, count(*) AS cnt FROM raw_geolocation
WHERE {ZIP} IN (SELECT {ZIP} FROM raw_geolocation GROUP BY {ZIP} HAVING count(DISTINCT geolocation_state) > 1)
GROUP BY {ZIP}, geolocation_state""",
    "geo_out_of_bounds": """SELECT * FROM raw_geolocation
WHERE geolocation_lat NOT BETWEEN -35 AND 6 OR geolocation_lng NOT BETWEEN -75 AND -30""",
    "row_filter_listing": "SELECT * FROM stg_order_payments WHERE payment_value = 0",
    "mode_confidence": f"""SELECT zip_prefix, CAST(row_cnt AS BIGINT) AS row_cnt, mode_cnt, {pct("mode_cnt", "row_cnt")} AS mode_ratio_pct
FROM geo_counts JOIN point_mode USING (zip_prefix)""",
    "mode_confidence_low": f"SELECT {ZIP}, row_cnt, mode_cnt, mode_ratio_pct FROM stg_geolocation WHERE mode_ratio_pct < 5",
    "mode_confidence_low_gap": f"SELECT {ZIP}, row_cnt, mode_cnt, mode_ratio_pct FROM stg_geolocation WHERE mode_ratio_pct < 30",
    "mode_confidence_summary": f"""SELECT low_mode_cnt, total_cnt, {pct("low_mode_cnt", "total_cnt")} AS low_mode_pct
FROM (SELECT {n("mode_ratio_pct < 5")} AS low_mode_cnt, count(*) AS total_cnt FROM stg_geolocation) AS t""",
    # row rules
    "event_order_anomalies": union(
        [
            f"SELECT '{c}' AS column_name, {n(f'{c} < order_purchase_dt')} AS early_cnt FROM parsed_orders"
            for c in ("order_approved_dt", "order_delivered_carrier_dt", "order_delivered_customer_dt")
        ]
    ),
    "event_order_anomaly_rows": """SELECT order_id, order_status, order_purchase_dt, order_delivered_carrier_dt
FROM parsed_orders WHERE order_delivered_carrier_dt < order_purchase_dt""",
    "status_time_contradictions": violations(
        "parsed_orders",
        {
            "delivered_without_delivery_time": "order_status = 'delivered' AND order_delivered_customer_dt IS NULL",
            "failed_with_delivery_time": "order_status IN ('canceled', 'unavailable') AND order_delivered_customer_dt IS NOT NULL",
            "approved_without_approval_time": "order_status = 'approved' AND order_approved_dt IS NULL",
            "in_transit_without_carrier_time": "order_status IN ('shipped', 'invoiced') AND order_delivered_carrier_dt IS NULL",
        },
    ),
    "negative_values": negatives("stg_orders", ["approve_lead_days", "delivery_lead_days", "delivery_delay_days"]),
    "negative_values_kpi": negatives(
        "kpi_core", ["gross_revenue", "order_cnt", "active_buyers", "aov", "repeat_buyers"]
    ),
    "flag_counts": union(
        [
            f"SELECT '{f}' AS flag_col, {n(f'{f} = 1')} AS cnt FROM stg_orders"
            for f in ("is_time_inconsistent", "is_status_inconsistent", "is_carrier_dt_missing")
        ]
    ),
    "derived_consistency": f"""SELECT {n("price + freight_value IS NOT NULL AND item_total_value IS NULL")} AS missing_cnt,
       {n("price + freight_value IS NULL AND item_total_value IS NOT NULL")} AS unexpected_cnt,
       {n("abs(item_total_value - (price + freight_value)) > 0.000001")} AS mismatch_cnt FROM stg_order_items""",
    "derived_consistency_gap": f"""SELECT {n("price IS NOT NULL AND item_total_value IS NULL")} AS missing_cnt,
       {n("price IS NULL AND item_total_value IS NOT NULL")} AS unexpected_cnt,
       {n("abs(item_total_value - price) > 0.000001")} AS mismatch_cnt FROM stg_order_items""",
    "flag_rule_consistency": violations(
        "stg_geolocation",
        {
            "invalid_latlng": f"is_invalid_latlng_exists <> {flag('invalid_latlng_cnt > 0')}",
            "multi_city": f"is_multi_city <> {flag('city_cnt > 1')}",
            "multi_state": f"is_multi_state <> {flag('state_cnt > 1')}",
            "point_known": f"is_invalid_latlng_exists <> {flag('geolocation_lat IS NULL')}",
        },
    ),
    "flag_rule_consistency_products": violations(
        "dim_product",
        {
            "category_blank": f"is_category_blank <> {flag('product_category_name IS NULL')}",
            "category_unmapped": "is_category_en_unmapped <> "
            + flag("product_category_name IS NOT NULL AND product_category_name_en IS NULL"),
            "weight_zero": f"is_weight_zero <> {flag('product_weight_g = 0')}",
            "weight_known": f"is_weight_zero <> {flag('product_weight_g IS NOT NULL')}",
        },
    ),
    "flag_agreement_reviews": violations(
        "stg_order_reviews",
        {
            "title_blank": f"is_title_blank <> {flag('review_comment_title IS NULL')}",
            "message_blank": f"is_message_blank <> {flag('review_comment_message IS NULL')}",
            "title_blank_as_message": f"is_title_blank <> {flag('review_comment_message IS NULL')}",
        },
    ),
    "flag_rule_consistency_calendar": violations(
        "dim_date",
        {
            "weekend": f"is_weekend <> {flag('day_of_week IN (6, 7)')}",
            "month_start": "is_month_start <> " + flag('day("date") = 1'),
            "month_end": "is_month_end <> " + flag('"date" = last_day("date")'),
            "weekend_is_month_end": "is_weekend <> is_month_end",
        },
    ),
    # references
    "orphan_count": f"SELECT count(*) AS orphan_cnt {orphans('raw_orders', 'order_id', 'raw_order_items', 'order_id')}",
    "orphan_count_payments": f"SELECT count(*) AS orphan_cnt {orphans('stg_order_payments', 'order_id', 'stg_orders', 'order_id')}",
    "orphan_count_zip": f"SELECT count(*) AS orphan_cnt {orphans('fact_order_items', 'seller_zip_code_prefix', 'dim_geolocation', ZIP)}",
    "orphan_values": f"""SELECT order_id AS "key", count(*) AS cnt
{orphans("raw_orders", "order_id", "raw_order_payments", "order_id")} GROUP BY order_id""",
    "orphan_drilldown": f"""SELECT customer_zip_code_prefix AS "key", count(*) AS cnt,
       CAST(max(CASE WHEN customer_zip_code_prefix IN (SELECT {clean(ZIP)} FROM raw_geolocation) THEN 1 ELSE 0 END) AS INTEGER) AS exists_in_raw
{orphans("stg_customers", "customer_zip_code_prefix", "stg_geolocation", ZIP)} GROUP BY customer_zip_code_prefix""",
    "coverage_pct": coverage("stg_customers", "customer_zip_code_prefix", "stg_geolocation", ZIP),
    "coverage_pct_orders": coverage("stg_order_reviews", "order_id", "stg_orders", "order_id"),
    "cross_table_event_order": event_order("stg_order_items", "shipping_limit_dt", "order_purchase_dt"),
    "cross_table_event_order_reviews": event_order("stg_order_reviews", "review_creation_dt", "order_purchase_dt"),
    "event_gap_histogram": f"""SELECT gap AS gap_min, count(*) AS cnt
FROM {early("stg_order_items", "shipping_limit_dt", "order_approved_dt")} GROUP BY gap""",
    "anomaly_attribution": f"""SELECT count(*) AS anomaly_cnt, {n("parts > 1")} AS in_repeated_keys,
       {n("parts IS NULL OR parts <= 1")} AS in_single_keys
FROM (SELECT order_id FROM stg_orders AS o WHERE order_id NOT IN (SELECT order_id FROM stg_order_items)
        OR EXISTS (SELECT 1 FROM stg_order_reviews AS r WHERE r.order_id = o.order_id AND r.review_creation_dt < o.order_purchase_dt)) AS a
LEFT JOIN (SELECT order_id, count(*) AS parts FROM stg_order_payments GROUP BY order_id) AS p USING (order_id)""",
    # layers
    "copy_mismatch": mismatches(
        "dim_customer",
        "stg_customers",
        "customer_id",
        ["customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state", "customer_city_state"],
    ),
    "copy_mismatch_raw": mismatches(
        "stg_sellers", "raw_sellers", "seller_id", ["seller_zip_code_prefix", "seller_city", "seller_state"]
    ),
    "view_vs_source": """SELECT v.year_month, v.order_cnt, coalesce(s.order_cnt, 0) AS order_cnt_source,
       v.order_cnt - coalesce(s.order_cnt, 0) AS order_cnt_diff
FROM kpi_core AS v LEFT JOIN (SELECT order_year_month AS year_month, count(*) AS order_cnt FROM stg_orders
  WHERE order_status = 'delivered' AND is_delivered = 1 GROUP BY 1) AS s USING (year_month)
WHERE v.order_cnt <> coalesce(s.order_cnt, 0)""",
    "view_vs_source_gap": """SELECT v.year_month, v.order_cnt, total_orders AS order_cnt_source, v.order_cnt - total_orders AS order_cnt_diff
FROM kpi_core AS v JOIN kpi_cancel AS s USING (year_month) WHERE v.order_cnt <> total_orders""",
    "grand_total_reconcile": totals(
        {
            "revenue: items vs months": ("delivered_items", "sum(item_total_value)", "kpi_core", "sum(gross_revenue)"),
            "revenue: persons vs cohorts": ("base", "sum(gross_revenue)", "cohort_core", "sum(cohort_gross_revenue)"),
            "orders: persons vs cohorts": ("base", "sum(order_cnt)", "cohort_core", "sum(cohort_order_cnt)"),
        }
    ),
    "grand_total_reconcile_gap": totals({"orders: all vs delivered": ("fact_orders", "count(*)", "kpi_core", "sum(order_cnt)")}),
    "row_count_reconcile_star": union(
        [
            f"SELECT '{entity}' AS entity, {source} AS source_cnt, count(*) AS target_cnt, count(*) - {source} AS diff FROM {target}"
            for entity, source, target in [
                ("customers", "(SELECT count(*) FROM stg_customers)", "dim_customer"),
                ("products", "(SELECT count(*) FROM stg_products)", "dim_product"),
                ("sellers", "(SELECT count(*) FROM stg_sellers)", "dim_seller"),
                ("geolocation", "(SELECT count(*) FROM stg_geolocation)", "dim_geolocation"),
                ("orders", "(SELECT count(*) FROM stg_orders)", "fact_orders"),
                ("order_items", "(SELECT count(*) FROM stg_order_items)", "fact_order_items"),
                (
                    "order_items with an order",
                    "(SELECT count(*) FROM stg_order_items AS i JOIN stg_orders AS o ON o.order_id = i.order_id)",
                    "fact_order_items",
                ),
            ]
        ]
    ),
    "view_vs_source_person_month": """SELECT * FROM (
  SELECT v.customer_unique_id, v.year_month, v.order_cnt, v.item_cnt, v.gross_revenue, o.order_cnt AS order_cnt_source,
         i.item_cnt AS item_cnt_source, i.gross_revenue AS gross_revenue_source, v.order_cnt - o.order_cnt AS order_cnt_diff,
         v.item_cnt - i.item_cnt AS item_cnt_diff, v.gross_revenue - i.gross_revenue AS gross_revenue_diff
  FROM base AS v JOIN person_orders AS o ON o.customer_unique_id = v.customer_unique_id AND o.year_month = v.year_month
  JOIN person_items AS i ON i.customer_unique_id = v.customer_unique_id AND i.year_month = v.year_month) AS t
WHERE order_cnt_diff <> 0 OR item_cnt_diff <> 0 OR gross_revenue_diff <> 0""",
    "view_vs_source_person_month_gap": """SELECT v.customer_unique_id, v.year_month, v.order_cnt, i.item_cnt AS order_cnt_source,
       v.order_cnt - i.item_cnt AS order_cnt_diff
FROM base AS v JOIN person_items AS i ON i.customer_unique_id = v.customer_unique_id AND i.year_month = v.year_month
WHERE v.order_cnt <> i.item_cnt""",
    "copy_mismatch_geolocation": mismatches(
        "dim_geolocation",
        "stg_geolocation",
        ZIP,
        [
            "geolocation_lat",
            "geolocation_lng",
            "geolocation_city",
            "geolocation_state",
            "geolocation_city_state",
            "row_cnt",
            "mode_cnt",
            "mode_ratio_pct",
            "invalid_latlng_cnt",
            "city_cnt",
            "state_cnt",
            "is_invalid_latlng_exists",
            "is_multi_city",
            "is_multi_state",
        ],
    ),
    "copy_mismatch_product": mismatches(
        "dim_product",
        "stg_products",
        "product_id",
        [
            "product_category_name",
            "product_category_name_en",
            "product_name_length",
            "product_description_length",
            "product_photos_qty",
            "product_weight_g",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
            "product_volume_cm3",
            "is_category_blank",
            "is_category_en_unmapped",
            "is_weight_zero",
        ],
    ),
    "copy_mismatch_seller": mismatches(
        "dim_seller", "stg_sellers", "seller_id", ["seller_zip_code_prefix", "seller_city", "seller_state", "seller_city_state"]
    ),
    # KPI and cohort invariants
    "buyer_flag_invariants": violations(
        "base",
        {
            "new_and_repeat": "is_new_buyer = 1 AND is_repeat_buyer = 1",
            "new_after_month_0": "is_new_buyer = 1 AND month_n <> 0",
            "month_before_cohort": "year_month < cohort_year_month",
            "orders_without_items_or_revenue": "order_cnt > 0 AND item_cnt = 0 AND gross_revenue = 0",
        },
    ),
    "kpi_range_report": kpi_ranges(
        "kpi_core", ["gross_revenue", "order_cnt", "active_buyers", "aov", "repeat_buyers", "repeat_buyer_rate"]
    ),
    "kpi_range_report_cancellation": kpi_ranges(
        "kpi_cancel",
        "total_orders canceled_orders unavailable_orders failed_orders cancel_rate unavailable_rate failed_rate".split(),
    ),
    "kpi_range_report_cohorts": kpi_ranges(
        "cohort_core",
        """month_n cohort_size cohort_active_buyers cohort_order_cnt cohort_gross_revenue cohort_retention_rate cohort_aov
        cum_gross_revenue cum_order_cnt""".split(),
    ),
    "month_axis_completeness": union(
        [
            f"""SELECT '{name}' AS table_name, count(DISTINCT year_month) AS month_cnt, min(year_month) AS min_month,
            max(year_month) AS max_month FROM {table}"""
            for name, table in {
                "kpi_monthly_core": "kpi_core",
                "kpi_monthly_cancellation": "kpi_cancel",
                "vw_delivered_orders": "delivered_orders",
                "dim_date": "dim_date",
            }.items()
        ]
    ),
    "sum_identity": """SELECT year_month, canceled_orders, unavailable_orders, failed_orders,
       canceled_orders + unavailable_orders - failed_orders AS diff
FROM kpi_cancel WHERE canceled_orders + unavailable_orders <> failed_orders""",
    "sum_identity_gap": """SELECT year_month, canceled_orders, unavailable_orders, total_orders,
       canceled_orders + unavailable_orders - total_orders AS diff
FROM kpi_cancel WHERE canceled_orders + unavailable_orders <> total_orders""",
    "sequence_gap": """SELECT * FROM (SELECT cohort_year_month, month_n,
  CAST(row_number() OVER (PARTITION BY cohort_year_month ORDER BY month_n) - 1 AS INTEGER) AS position FROM cohort_core) AS t
WHERE month_n <> position""",
    "sequence_gap_sparse": """SELECT * FROM (SELECT cohort_year_month, month_n,
  CAST(row_number() OVER (PARTITION BY cohort_year_month ORDER BY month_n) - 1 AS INTEGER) AS position FROM cohort_values) AS t
WHERE month_n <> position""",
    "constant_within_group": """SELECT cohort_year_month, min(cohort_size) AS min_value, max(cohort_size) AS max_value
FROM cohort_core GROUP BY 1 HAVING min(cohort_size) <> max(cohort_size)""",
    "constant_within_group_gap": """SELECT cohort_year_month, min(cohort_active_buyers) AS min_value, max(cohort_active_buyers) AS max_value
FROM cohort_core GROUP BY 1 HAVING min(cohort_active_buyers) <> max(cohort_active_buyers)""",
    "ratio_recompute": f"""SELECT * FROM (SELECT cohort_year_month, month_n, cohort_retention_rate AS stored,
  {ratio("cohort_active_buyers", "cohort_size")} AS recomputed FROM cohort_core) AS t WHERE abs(stored - recomputed) > 0.000001""",
    "ratio_recompute_gap": f"""SELECT * FROM (SELECT cohort_year_month, month_n, cohort_aov AS stored,
  {ratio("cohort_gross_revenue", "cohort_active_buyers", 2, MONEY, 2)} AS recomputed FROM cohort_core) AS t
WHERE abs(stored - recomputed) > 0.01""",
    "monotone_cumulative": """SELECT * FROM (SELECT cohort_year_month, month_n, cum_gross_revenue AS value,
  lag(cum_gross_revenue) OVER (PARTITION BY cohort_year_month ORDER BY month_n) AS previous FROM cohort_core) AS t WHERE value < previous""",
    "monotone_cumulative_gap": """SELECT * FROM (SELECT cohort_year_month, month_n, cohort_order_cnt AS value,
  lag(cohort_order_cnt) OVER (PARTITION BY cohort_year_month ORDER BY month_n) AS previous FROM cohort_core) AS t WHERE value < previous""",
    "month0_invariants": month0("cohort_core"),
    "month0_invariants_gap": month0("(SELECT * REPLACE (CAST(month_n - 1 AS INTEGER) AS month_n) FROM cohort_core)"),
    "last_cumulative_equals_total": f"""SELECT * FROM (SELECT cohort_year_month, arg_max(cum_gross_revenue, month_n) AS last_cumulative,
  CAST(sum(cohort_gross_revenue) AS DECIMAL(28,2)) AS total FROM cohort_core GROUP BY 1) AS t
WHERE abs(last_cumulative - total) > 0.001""",
    "last_cumulative_equals_total_gap": """SELECT * FROM (SELECT cohort_year_month, arg_max(cohort_size, month_n) AS last_cumulative,
  CAST(sum(cohort_active_buyers) AS BIGINT) AS total FROM cohort_core GROUP BY 1) AS t
WHERE abs(last_cumulative - total) > 0.001""",
    "cohort_order_history": """SELECT f.customer_unique_id, order_id, order_purchase_date_key, year_month, order_purchase_dt,
       order_delivered_customer_dt
FROM first_purchase AS f JOIN dim_customer AS c ON c.customer_unique_id = f.customer_unique_id
JOIN delivered_orders AS o ON o.customer_id = c.customer_id WHERE first_purchase_year_month IN ('1995-01', '1995-03')""",
    "calendar_boundary_checks": """SELECT "date", week_of_year, day_of_week, day_name FROM dim_date
WHERE "month" = 12 AND "day" >= 25 OR "month" = 1 AND "day" <= 10 OR day_of_week NOT BETWEEN 1 AND 7""",
}
