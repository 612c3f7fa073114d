"""Raw -> staging: typed, cleaned and flagged tables. Doubtful rows are flagged, not deleted.

Every function is one narrow pass over its input except ``stg_products`` (small lookup) and
``stg_geolocation`` (aggregation to one row per zip).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewinds.functions import (
    calendar_parts,
    clean_text,
    joined_label,
    lead_days,
    parse_ts,
    percent,
    to_flag,
)
from tradewinds.operators.aggregates import mode_by_key
from tradewinds.operators.joins import lookup_join

FAILED_STATUSES = ("canceled", "unavailable")
IN_TRANSIT_STATUSES = ("shipped", "invoiced")

# Bounding box of the market, inclusive.
LAT_RANGE = (-35, 6)
LNG_RANGE = (-75, -30)


def _present(*columns: str) -> Column:
    """All id columns are neither NULL nor empty."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & (F.col(c) != "")
    return out


# --- orders ---------------------------------------------------------------------------


def approve_lead_days() -> Column:
    return lead_days("order_purchase_dt", "order_approved_dt")


def delivery_lead_days() -> Column:
    return lead_days("order_purchase_dt", "order_delivered_customer_dt")


def delivery_delay_days() -> Column:
    """Delivered minus estimated (negative = early); NULL if delivery precedes the purchase."""
    return lead_days("estimated_ts", "order_delivered_customer_dt", not_before="order_purchase_dt")


def is_delivered() -> Column:
    return to_flag(F.col("order_delivered_customer_dt").isNotNull())


def is_canceled() -> Column:
    return to_flag(F.col("order_status").isin(*FAILED_STATUSES))


def is_time_inconsistent() -> Column:
    """An approval, hand-over or delivery earlier than the purchase; missing times do not count."""
    bought = F.col("order_purchase_dt")
    return to_flag(
        (F.col("order_approved_dt") < bought)
        | (F.col("order_delivered_carrier_dt") < bought)
        | (F.col("order_delivered_customer_dt") < bought)
    )


def is_status_inconsistent() -> Column:
    arrived = F.col("order_delivered_customer_dt").isNotNull()
    status = F.col("order_status")
    return to_flag(((status == "delivered") & ~arrived) | (status.isin(*FAILED_STATUSES) & arrived))


def is_carrier_dt_missing() -> Column:
    return to_flag(F.col("order_status").isin(*IN_TRANSIT_STATUSES) & F.col("order_delivered_carrier_dt").isNull())


def parsed_orders(raw_orders: DataFrame) -> DataFrame:
    """Typed columns of an order, before derived columns and before the purchase-time rule."""
    return raw_orders.select(
        "order_id",
        "customer_id",
        clean_text("order_status", case="lower").alias("order_status"),
        parse_ts("order_purchase_timestamp").alias("order_purchase_dt"),
        parse_ts("order_approved_at").alias("order_approved_dt"),
        parse_ts("order_delivered_carrier_date").alias("order_delivered_carrier_dt"),
        parse_ts("order_delivered_customer_date").alias("order_delivered_customer_dt"),
        parse_ts("order_estimated_delivery_date").alias("estimated_ts"),
    )


def stg_orders(raw_orders: DataFrame) -> DataFrame:
    """One row per order whose purchase time parses."""
    return (
        parsed_orders(raw_orders)
        .filter(F.col("order_purchase_dt").isNotNull())
        .select(
            "order_id",
            "customer_id",
            "order_status",
            "order_purchase_dt",
            "order_approved_dt",
            "order_delivered_carrier_dt",
            "order_delivered_customer_dt",
            F.col("estimated_ts").cast("date").alias("order_estimated_delivery_dt"),
            F.col("order_purchase_dt").cast("date").alias("order_purchase_date"),
            *calendar_parts("order_purchase_dt"),
            approve_lead_days().alias("approve_lead_days"),
            delivery_lead_days().alias("delivery_lead_days"),
            delivery_delay_days().alias("delivery_delay_days"),
            is_delivered().alias("is_delivered"),
            is_canceled().alias("is_canceled"),
            is_time_inconsistent().alias("is_time_inconsistent"),
            is_status_inconsistent().alias("is_status_inconsistent"),
            is_carrier_dt_missing().alias("is_carrier_dt_missing"),
        )
    )


# --- customers and sellers --------------------------------------------------------------


def stg_customers(raw_customers: DataFrame) -> DataFrame:
    """Cleaned address; blank text stays blank."""
    city = clean_text("customer_city", case="lower")
    state = clean_text("customer_state", case="upper")
    return raw_customers.filter(_present("customer_id")).select(
        "customer_id",
        "customer_unique_id",
        clean_text("customer_zip_code_prefix").alias("customer_zip_code_prefix"),
        city.alias("customer_city"),
        state.alias("customer_state"),
        joined_label(city, state).alias("customer_city_state"),
    )


def stg_sellers(raw_sellers: DataFrame) -> DataFrame:
    """Cleaned address; blank text becomes NULL and takes the label with it."""
    city = clean_text("seller_city", case="lower", blank_to_null=True)
    state = clean_text("seller_state", case="upper", blank_to_null=True)
    return raw_sellers.filter(F.trim("seller_id") != "").select(
        "seller_id",
        clean_text("seller_zip_code_prefix", blank_to_null=True).alias("seller_zip_code_prefix"),
        city.alias("seller_city"),
        state.alias("seller_state"),
        joined_label(city, state).alias("seller_city_state"),
    )


# --- items, payments, reviews -------------------------------------------------------------


def stg_order_items(raw_items: DataFrame) -> DataFrame:
    ids = ["order_id", "order_item_id", "product_id", "seller_id"]
    parsed = raw_items.dropna(subset=ids).select(
        *ids, parse_ts("shipping_limit_date").alias("shipping_limit_dt"), "price", "freight_value"
    )
    return parsed.select(
        *ids,
        "shipping_limit_dt",
        "price",
        "freight_value",
        F.col("shipping_limit_dt").cast("date").alias("shipping_limit_date"),
        F.trim("order_item_id").try_cast("int").alias("order_item_seq"),
        F.round(F.col("price") + F.col("freight_value"), 2).try_cast("decimal(10,2)").alias("item_total_value"),
    )


def stg_order_payments(raw_payments: DataFrame) -> DataFrame:
    return raw_payments.filter(_present("order_id") & F.col("payment_sequential").isNotNull()).select(
        "order_id",
        "payment_sequential",
        clean_text("payment_type", case="lower", drop_cr=False).alias("payment_type"),
        "payment_installments",
        "payment_value",
        to_flag(F.col("payment_installments") == 0).alias("is_installments_zero"),
        to_flag(F.col("payment_value") == 0).alias("is_payment_value_zero"),
    )


def stg_order_reviews(raw_reviews: DataFrame) -> DataFrame:
    cleaned = raw_reviews.filter(_present("review_id", "order_id") & F.col("review_score").isNotNull()).select(
        "review_id",
        "order_id",
        "review_score",
        clean_text("review_comment_title", blank_to_null=True).alias("review_comment_title"),
        clean_text("review_comment_message", blank_to_null=True).alias("review_comment_message"),
        parse_ts("review_creation_date").alias("review_creation_dt"),
        parse_ts("review_answer_timestamp").alias("review_answer_dt"),
    )
    return cleaned.select(
        "*",
        F.col("review_creation_dt").cast("date").alias("review_creation_date"),
        F.col("review_answer_dt").cast("date").alias("review_answer_date"),
        to_flag(F.col("review_comment_title").isNull()).alias("is_title_blank"),
        to_flag(F.col("review_comment_message").isNull()).alias("is_message_blank"),
    )


# --- products -----------------------------------------------------------------------------


def lookup_translate(
    df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, value: str, out: str, found: str
) -> DataFrame:
    """Left lookup on cleaned keys of both sides; adds ``out`` and a 0/1 ``found``, drops nothing."""
    table = lookup.select(
        clean_text(lookup_key, case="lower", blank_to_null=True).alias(key),
        clean_text(value, case="lower", blank_to_null=True).alias(out),
        F.lit(1).alias(found),
    ).filter(F.col(key).isNotNull())
    cleaned = df.withColumn(key, clean_text(key, case="lower", blank_to_null=True))
    return lookup_join(cleaned, table, key, "left").withColumn(found, F.coalesce(found, F.lit(0)))


def volume_cm3(length: str, height: str, width: str) -> Column:
    """L x H x W as BIGINT; widened before multiplying, NULL unless all three are known."""
    return F.col(length).cast("long") * F.col(height).cast("long") * F.col(width).cast("long")


def product_flags(category: str = "product_category_name", found: str = "_translated") -> list[Column]:
    return [
        to_flag(F.col(category).isNull()).alias("is_category_blank"),
        to_flag(F.col(category).isNotNull() & (F.col(found) == 0)).alias("is_category_en_unmapped"),
        to_flag(F.col("product_weight_g") == 0).alias("is_weight_zero"),
    ]


def stg_products(raw_products: DataFrame, raw_translation: DataFrame) -> DataFrame:
    translated = lookup_translate(
        raw_products.filter(_present("product_id")),
        raw_translation,
        key="product_category_name",
        lookup_key="product_category_name",
        value="product_category_name_english",
        out="product_category_name_en",
        found="_translated",
    )
    return translated.select(
        "product_id",
        "product_category_name",
        "product_category_name_en",
        "product_name_length",
        "product_description_length",
        "product_photos_qty",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
        volume_cm3("product_length_cm", "product_height_cm", "product_width_cm").alias("product_volume_cm3"),
        *product_flags(),
    )


# --- geolocation --------------------------------------------------------------------------


def geo_valid_flag(lat: str, lng: str) -> Column:
    """1 inside the bounding box, 0 outside or unknown."""
    return to_flag(F.col(lat).between(*LAT_RANGE) & F.col(lng).between(*LNG_RANGE))


def geo_points(raw_geolocation: DataFrame) -> DataFrame:
    """Cleaned points with a usable zip prefix."""
    return raw_geolocation.select(
        clean_text("geolocation_zip_code_prefix", blank_to_null=True).alias("zip_prefix"),
        F.col("geolocation_lat").alias("lat"),
        F.col("geolocation_lng").alias("lng"),
        clean_text("geolocation_city", case="lower").alias("city"),
        clean_text("geolocation_state", case="upper").alias("state"),
        geo_valid_flag("geolocation_lat", "geolocation_lng").alias("is_valid"),
    ).filter(F.col("zip_prefix").isNotNull())


POINT, PLACE, CITY, STATE = 1, 2, 3, 4


def _geo_frequencies(points: DataFrame) -> DataFrame:
    """Row counts of the points, places, cities and states of each zip, in one shuffle.

    ``kind`` says which of the four groupings a row belongs to. The value columns are part
    of the shuffle key, so a zip holding a third of the rows is spread over many tasks.
    """
    c = F.col
    zip_, lat, lng, valid, city, state = (c(n) for n in ("zip_prefix", "lat", "lng", "is_valid", "city", "state"))
    grouped = points.groupingSets(
        [[zip_, lat, lng, valid], [zip_, city, state], [zip_, city], [zip_, state]], zip_, lat, lng, valid, city, state
    ).agg(
        F.grouping("lat").alias("no_point"),
        F.grouping("city").alias("no_city"),
        F.grouping("state").alias("no_state"),
        F.count(F.lit(1)).alias("n"),
    )
    kind = (
        F.when(c("no_point") == 0, POINT)
        .when((c("no_city") == 0) & (c("no_state") == 0), PLACE)
        .when(c("no_city") == 0, CITY)
        .otherwise(STATE)
    )
    return grouped.select("zip_prefix", kind.alias("kind"), "lat", "lng", "is_valid", "city", "state", "n")


def _zip_counts() -> list[Column]:
    kind = F.col("kind")
    return [
        F.sum(F.when(kind == POINT, F.col("n"))).alias("row_cnt"),
        F.sum(F.when((kind == POINT) & (F.col("is_valid") == 0), F.col("n")).otherwise(0)).alias("invalid_latlng_cnt"),
        F.count_if((kind == CITY) & F.col("city").isNotNull()).alias("city_cnt"),
        F.count_if((kind == STATE) & F.col("state").isNotNull()).alias("state_cnt"),
    ]


def geo_zip_agg(points: DataFrame) -> DataFrame:
    """Per zip: rows, rows off the map, distinct cities, distinct states."""
    return _geo_frequencies(points).groupBy("zip_prefix").agg(*_zip_counts())


def geo_point_mode(points: DataFrame, collation: str | None = None) -> DataFrame:
    """Most frequent valid point per zip; zips without a valid point are absent."""
    return mode_by_key(points.filter("is_valid = 1"), "zip_prefix", ["lat", "lng"], "mode_cnt", collation)


def geo_place_mode(points: DataFrame, collation: str | None = None) -> DataFrame:
    """Most frequent (city, state) pair per zip over all rows."""
    return mode_by_key(points, "zip_prefix", ["city", "state"], "place_cnt", collation)


def _assembled() -> list[Column]:
    return [
        F.col("zip_prefix").alias("geolocation_zip_code_prefix"),
        F.col("lat").alias("geolocation_lat"),
        F.col("lng").alias("geolocation_lng"),
        F.col("city").alias("geolocation_city"),
        F.col("state").alias("geolocation_state"),
        joined_label("city", "state").alias("geolocation_city_state"),
        "row_cnt",
        F.coalesce("mode_cnt", F.lit(0)).alias("mode_cnt"),
        percent(F.coalesce("mode_cnt", F.lit(0)), F.col("row_cnt")).alias("mode_ratio_pct"),
        "invalid_latlng_cnt",
        "city_cnt",
        "state_cnt",
        to_flag(F.col("invalid_latlng_cnt") > 0).alias("is_invalid_latlng_exists"),
        to_flag(F.col("city_cnt") > 1).alias("is_multi_city"),
        to_flag(F.col("state_cnt") > 1).alias("is_multi_state"),
    ]


def geo_assemble(zip_agg: DataFrame, point_mode: DataFrame, place_mode: DataFrame) -> DataFrame:
    """Join the three per-zip frames; a zip without a valid point keeps NULL coordinates and mode_cnt 0."""
    joined = zip_agg.join(point_mode, "zip_prefix", "left").join(place_mode, "zip_prefix", "left")
    return joined.select(*_assembled())


def stg_geolocation(raw_geolocation: DataFrame, collation: str | None = None) -> DataFrame:
    """One row per zip prefix.

    The default path reads the points once, has two shuffles and no join: the four groupings of
    ``_geo_frequencies`` hold everything the row needs. With a collation the pieces are
    computed apart, because equal spellings must meet first.
    """
    points = geo_points(raw_geolocation)
    if collation is not None:
        folded = points.withColumns({c: F.collate(c, collation) for c in ("city", "state")})
        counts = folded.groupBy("zip_prefix").agg(
            F.count(F.lit(1)).alias("row_cnt"),
            F.count_if(F.col("is_valid") == 0).alias("invalid_latlng_cnt"),
            F.count_distinct("city").alias("city_cnt"),
            F.count_distinct("state").alias("state_cnt"),
        )
        return geo_assemble(counts, geo_point_mode(points), geo_place_mode(points, collation))
    kind = F.col("kind")
    fewest = (-F.col("n")).alias("n")
    per_zip = (
        _geo_frequencies(points)
        .groupBy("zip_prefix")
        .agg(
            *_zip_counts(),
            F.min(F.when((kind == POINT) & (F.col("is_valid") == 1), F.struct(fewest, "lat", "lng"))).alias("point"),
            F.min(F.when(kind == PLACE, F.struct(fewest, "city", "state"))).alias("place"),
        )
    )
    return per_zip.select(
        "zip_prefix",
        "row_cnt",
        "invalid_latlng_cnt",
        "city_cnt",
        "state_cnt",
        "point.lat",
        "point.lng",
        (-F.col("point.n")).alias("mode_cnt"),
        "place.city",
        "place.state",
    ).select(*_assembled())
