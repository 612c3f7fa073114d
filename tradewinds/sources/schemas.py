"""Fixed schemas of the raw tables and of the tables of the layers. Raw times stay text so that bad values survive the load."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT = T.StringType()
INT = T.IntegerType()
MONEY = T.DecimalType(10, 2)
COORDINATE = T.DecimalType(10, 6)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


RAW_SCHEMAS: dict[str, T.StructType] = {
    "orders": _schema(
        order_id=TEXT,
        customer_id=TEXT,
        order_status=TEXT,
        order_purchase_timestamp=TEXT,
        order_approved_at=TEXT,
        order_delivered_carrier_date=TEXT,
        order_delivered_customer_date=TEXT,
        order_estimated_delivery_date=TEXT,
    ),
    "order_items": _schema(
        order_id=TEXT,
        order_item_id=TEXT,
        product_id=TEXT,
        seller_id=TEXT,
        shipping_limit_date=TEXT,
        price=MONEY,
        freight_value=MONEY,
    ),
    "order_payments": _schema(
        order_id=TEXT,
        payment_sequential=INT,
        payment_type=TEXT,
        payment_installments=INT,
        payment_value=MONEY,
    ),
    "order_reviews": _schema(
        review_id=TEXT,
        order_id=TEXT,
        review_score=INT,
        review_comment_title=TEXT,
        review_comment_message=TEXT,
        review_creation_date=TEXT,
        review_answer_timestamp=TEXT,
    ),
    "customers": _schema(
        customer_id=TEXT,
        customer_unique_id=TEXT,
        customer_zip_code_prefix=TEXT,
        customer_city=TEXT,
        customer_state=TEXT,
    ),
    "products": _schema(
        product_id=TEXT,
        product_category_name=TEXT,
        product_name_length=INT,
        product_description_length=INT,
        product_photos_qty=INT,
        product_weight_g=INT,
        product_length_cm=INT,
        product_height_cm=INT,
        product_width_cm=INT,
    ),
    "sellers": _schema(
        seller_id=TEXT,
        seller_zip_code_prefix=TEXT,
        seller_city=TEXT,
        seller_state=TEXT,
    ),
    "geolocation": _schema(
        geolocation_zip_code_prefix=TEXT,
        geolocation_lat=COORDINATE,
        geolocation_lng=COORDINATE,
        geolocation_city=TEXT,
        geolocation_state=TEXT,
    ),
    "category_translation": _schema(
        product_category_name=TEXT,
        product_category_name_english=TEXT,
    ),
}



_KINDS: dict[str, T.DataType] = {
    "string": TEXT,
    "int": INT,
    "bigint": T.LongType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _ddl(columns: str) -> T.StructType:
    """A schema from lines of name and type; parsing it needs no session."""

    def kind(text: str) -> T.DataType:
        if text.startswith("decimal("):
            return T.DecimalType(*map(int, text[len("decimal(") : -1].split(",")))
        return _KINDS[text]

    lines = [line.strip().removesuffix(",").split(" ") for line in columns.strip().splitlines()]
    return T.StructType([T.StructField(name, kind(text), True) for name, text in lines])


# Names, order and types of the columns that users of these tables rely on.
TABLE_SCHEMAS: dict[str, T.StructType] = {
    "stg_orders": _ddl(
        """
        order_id string,
        customer_id string,
        order_status string,
        order_purchase_dt timestamp_ntz,
        order_approved_dt timestamp_ntz,
        order_delivered_carrier_dt timestamp_ntz,
        order_delivered_customer_dt timestamp_ntz,
        order_estimated_delivery_dt date,
        order_purchase_date date,
        order_year int,
        order_month int,
        order_year_month string,
        approve_lead_days int,
        delivery_lead_days int,
        delivery_delay_days int,
        is_delivered int,
        is_canceled int,
        is_time_inconsistent int,
        is_status_inconsistent int,
        is_carrier_dt_missing int
        """
    ),
    "stg_customers": _ddl(
        """
        customer_id string,
        customer_unique_id string,
        customer_zip_code_prefix string,
        customer_city string,
        customer_state string,
        customer_city_state string
        """
    ),
    "stg_order_items": _ddl(
        """
        order_id string,
        order_item_id string,
        product_id string,
        seller_id string,
        shipping_limit_dt timestamp_ntz,
        price decimal(10,2),
        freight_value decimal(10,2),
        shipping_limit_date date,
        order_item_seq int,
        item_total_value decimal(10,2)
        """
    ),
    "stg_products": _ddl(
        """
        product_id string,
        product_category_name string,
        product_category_name_en string,
        product_name_length int,
        product_description_length int,
        product_photos_qty int,
        product_weight_g int,
        product_length_cm int,
        product_height_cm int,
        product_width_cm int,
        product_volume_cm3 bigint,
        is_category_blank int,
        is_category_en_unmapped int,
        is_weight_zero int
        """
    ),
    "stg_sellers": _ddl(
        """
        seller_id string,
        seller_zip_code_prefix string,
        seller_city string,
        seller_state string,
        seller_city_state string
        """
    ),
    "stg_order_payments": _ddl(
        """
        order_id string,
        payment_sequential int,
        payment_type string,
        payment_installments int,
        payment_value decimal(10,2),
        is_installments_zero int,
        is_payment_value_zero int
        """
    ),
    "stg_order_reviews": _ddl(
        """
        review_id string,
        order_id string,
        review_score int,
        review_comment_title string,
        review_comment_message string,
        review_creation_dt timestamp_ntz,
        review_answer_dt timestamp_ntz,
        review_creation_date date,
        review_answer_date date,
        is_title_blank int,
        is_message_blank int
        """
    ),
    "stg_geolocation": _ddl(
        """
        geolocation_zip_code_prefix string,
        geolocation_lat decimal(10,6),
        geolocation_lng decimal(10,6),
        geolocation_city string,
        geolocation_state string,
        geolocation_city_state string,
        row_cnt bigint,
        mode_cnt bigint,
        mode_ratio_pct decimal(6,2),
        invalid_latlng_cnt bigint,
        city_cnt bigint,
        state_cnt bigint,
        is_invalid_latlng_exists int,
        is_multi_city int,
        is_multi_state int
        """
    ),
    "dim_date": _ddl(
        """
        date_key int,
        date date,
        year int,
        quarter int,
        month int,
        day int,
        year_month string,
        year_quarter string,
        week_of_year int,
        day_of_week int,
        day_name string,
        is_weekend int,
        is_month_start int,
        is_month_end int
        """
    ),
    "dim_geolocation": _ddl(
        """
        geolocation_zip_code_prefix string,
        geolocation_lat decimal(10,6),
        geolocation_lng decimal(10,6),
        geolocation_city string,
        geolocation_state string,
        geolocation_city_state string,
        row_cnt bigint,
        mode_cnt bigint,
        mode_ratio_pct decimal(6,2),
        invalid_latlng_cnt bigint,
        city_cnt bigint,
        state_cnt bigint,
        is_invalid_latlng_exists int,
        is_multi_city int,
        is_multi_state int
        """
    ),
    "dim_customer": _ddl(
        """
        customer_id string,
        customer_unique_id string,
        customer_zip_code_prefix string,
        customer_city string,
        customer_state string,
        customer_city_state string
        """
    ),
    "dim_product": _ddl(
        """
        product_id string,
        product_category_name string,
        product_category_name_en string,
        product_name_length int,
        product_description_length int,
        product_photos_qty int,
        product_weight_g int,
        product_length_cm int,
        product_height_cm int,
        product_width_cm int,
        product_volume_cm3 bigint,
        is_category_blank int,
        is_category_en_unmapped int,
        is_weight_zero int
        """
    ),
    "dim_seller": _ddl(
        """
        seller_id string,
        seller_zip_code_prefix string,
        seller_city string,
        seller_state string,
        seller_city_state string
        """
    ),
    "fact_order_items": _ddl(
        """
        order_id string,
        order_item_id string,
        order_item_seq int,
        customer_id string,
        product_id string,
        seller_id string,
        order_purchase_date_key int,
        customer_zip_code_prefix string,
        seller_zip_code_prefix string,
        price decimal(10,2),
        freight_value decimal(10,2),
        item_total_value decimal(10,2)
        """
    ),
    "fact_orders": _ddl(
        """
        order_id string,
        customer_id string,
        order_purchase_date_key int,
        customer_zip_code_prefix string,
        order_status string,
        order_purchase_dt timestamp_ntz,
        order_approved_dt timestamp_ntz,
        order_delivered_carrier_dt timestamp_ntz,
        order_delivered_customer_dt timestamp_ntz,
        order_estimated_delivery_dt date,
        approve_lead_days int,
        delivery_lead_days int,
        delivery_delay_days int,
        is_delivered int,
        is_canceled int
        """
    ),
    "base_customer_monthly_purchase": _ddl(
        """
        customer_unique_id string,
        year_month string,
        cohort_year_month string,
        month_n int,
        order_cnt bigint,
        item_cnt bigint,
        gross_revenue decimal(18,2),
        is_active int,
        is_new_buyer int,
        is_repeat_buyer int
        """
    ),
    "kpi_monthly_core": _ddl(
        """
        year_month string,
        gross_revenue decimal(18,2),
        order_cnt bigint,
        active_buyers bigint,
        aov decimal(18,2),
        repeat_buyers bigint,
        repeat_buyer_rate decimal(18,6)
        """
    ),
    "kpi_monthly_cancellation": _ddl(
        """
        year_month string,
        total_orders bigint,
        canceled_orders bigint,
        unavailable_orders bigint,
        failed_orders bigint,
        cancel_rate decimal(18,6),
        unavailable_rate decimal(18,6),
        failed_rate decimal(18,6)
        """
    ),
    "cohort_monthly_core": _ddl(
        """
        cohort_year_month string,
        year_month string,
        month_n int,
        cohort_size bigint,
        cohort_active_buyers bigint,
        cohort_order_cnt bigint,
        cohort_gross_revenue decimal(18,2),
        cohort_retention_rate decimal(18,6),
        cohort_aov decimal(18,2),
        cum_gross_revenue decimal(18,2),
        cum_order_cnt bigint
        """
    ),
}


def columns_of(table: str) -> list[str]:
    return TABLE_SCHEMAS[table].names


# Tables whose text may hold line breaks inside quotes.
MULTILINE_TABLES = frozenset({"order_reviews"})
