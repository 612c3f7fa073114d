"""Staging tables."""

from oracles.sqltext import clean, flag, pct, ts

PRODUCT_INTS = ["name_length", "description_length", "photos_qty", "weight_g", "length_cm", "height_cm", "width_cm"]

TABLES = {
    "parsed_orders": f"""
SELECT order_id, customer_id, {clean("order_status", "lower")} AS order_status,
       {ts("order_purchase_timestamp")} AS order_purchase_dt, {ts("order_approved_at")} AS order_approved_dt,
       {ts("order_delivered_carrier_date")} AS order_delivered_carrier_dt,
       {ts("order_delivered_customer_date")} AS order_delivered_customer_dt,
       {ts("order_estimated_delivery_date")} AS estimated_ts
FROM raw_orders""",
    "stg_orders": f"""
SELECT order_id, customer_id, order_status, order_purchase_dt, order_approved_dt, order_delivered_carrier_dt,
       order_delivered_customer_dt, CAST(estimated_ts AS DATE) AS order_estimated_delivery_dt,
       CAST(order_purchase_dt AS DATE) AS order_purchase_date,
       CAST(year(order_purchase_dt) AS INTEGER) AS order_year, CAST(month(order_purchase_dt) AS INTEGER) AS order_month,
       strftime(order_purchase_dt, '%Y-%m') AS order_year_month,
       CAST(CASE WHEN order_approved_dt >= order_purchase_dt
            THEN date_diff('day', CAST(order_purchase_dt AS DATE), CAST(order_approved_dt AS DATE)) END AS INTEGER) AS approve_lead_days,
       CAST(CASE WHEN order_delivered_customer_dt >= order_purchase_dt
            THEN date_diff('day', CAST(order_purchase_dt AS DATE), CAST(order_delivered_customer_dt AS DATE)) END AS INTEGER)
         AS delivery_lead_days,
       CAST(CASE WHEN order_delivered_customer_dt >= order_purchase_dt
            THEN date_diff('day', CAST(estimated_ts AS DATE), CAST(order_delivered_customer_dt AS DATE)) END AS INTEGER)
         AS delivery_delay_days,
       {flag("order_delivered_customer_dt IS NOT NULL")} AS is_delivered,
       {flag("order_status IN ('canceled', 'unavailable')")} AS is_canceled,
       {flag("least(order_approved_dt, order_delivered_carrier_dt, order_delivered_customer_dt) < order_purchase_dt")}
         AS is_time_inconsistent,
       {flag('''(order_status = 'delivered') AND order_delivered_customer_dt IS NULL
             OR order_status IN ('canceled', 'unavailable') AND order_delivered_customer_dt IS NOT NULL''')}
         AS is_status_inconsistent,
       {flag("order_status IN ('shipped', 'invoiced') AND order_delivered_carrier_dt IS NULL")} AS is_carrier_dt_missing
FROM parsed_orders WHERE order_purchase_dt IS NOT NULL""",
    "stg_customers": f"""
SELECT customer_id, customer_unique_id, {clean("customer_zip_code_prefix")} AS customer_zip_code_prefix,
       {clean("customer_city", "lower")} AS customer_city, {clean("customer_state", "upper")} AS customer_state,
       {clean("customer_city", "lower")} || '_' || {clean("customer_state", "upper")} AS customer_city_state
FROM raw_customers WHERE customer_id <> ''""",
    "stg_sellers": f"""
SELECT seller_id, {clean("seller_zip_code_prefix", blank_to_null=True)} AS seller_zip_code_prefix,
       {clean("seller_city", "lower", True)} AS seller_city, {clean("seller_state", "upper", True)} AS seller_state,
       {clean("seller_city", "lower", True)} || '_' || {clean("seller_state", "upper", True)} AS seller_city_state
FROM raw_sellers WHERE trim(seller_id) <> ''""",
    "stg_order_items": f"""
SELECT order_id, order_item_id, product_id, seller_id, {ts("shipping_limit_date")} AS shipping_limit_dt, price, freight_value,
       CAST({ts("shipping_limit_date")} AS DATE) AS shipping_limit_date,
       TRY_CAST(trim(order_item_id) AS INTEGER) AS order_item_seq,
       CAST(price + freight_value AS DECIMAL(10,2)) AS item_total_value
FROM raw_order_items
WHERE order_id IS NOT NULL AND order_item_id IS NOT NULL AND product_id IS NOT NULL AND seller_id IS NOT NULL""",
    "stg_order_payments": f"""
SELECT order_id, payment_sequential, lower(trim(payment_type)) AS payment_type, payment_installments, payment_value,
       {flag("payment_installments = 0")} AS is_installments_zero, {flag("payment_value = 0")} AS is_payment_value_zero
FROM raw_order_payments WHERE order_id <> '' AND payment_sequential IS NOT NULL""",
    "stg_order_reviews": f"""
SELECT review_id, order_id, review_score, {clean("review_comment_title", "", True)} AS review_comment_title,
       {clean("review_comment_message", "", True)} AS review_comment_message,
       {ts("review_creation_date")} AS review_creation_dt, {ts("review_answer_timestamp")} AS review_answer_dt,
       CAST({ts("review_creation_date")} AS DATE) AS review_creation_date,
       CAST({ts("review_answer_timestamp")} AS DATE) AS review_answer_date,
       {flag(clean("review_comment_title", "", True) + " IS NULL")} AS is_title_blank,
       {flag(clean("review_comment_message", "", True) + " IS NULL")} AS is_message_blank
FROM raw_order_reviews WHERE review_id <> '' AND order_id <> '' AND review_score IS NOT NULL""",
    "stg_products": f"""
SELECT product_id, category AS product_category_name, english AS product_category_name_en,
       {", ".join(f"product_{m}" for m in PRODUCT_INTS)},
       CAST(product_length_cm AS BIGINT) * CAST(product_height_cm AS BIGINT) * CAST(product_width_cm AS BIGINT) AS product_volume_cm3,
       {flag("category IS NULL")} AS is_category_blank,
       {flag("category IS NOT NULL AND known IS NULL")} AS is_category_en_unmapped,
       {flag("product_weight_g = 0")} AS is_weight_zero
FROM (SELECT *, {clean("product_category_name", "lower", True)} AS category FROM raw_products WHERE product_id <> '') AS p
LEFT JOIN (SELECT {clean("product_category_name", "lower", True)} AS known,
                  {clean("product_category_name_english", "lower", True)} AS english FROM raw_translation) AS t
  ON known = category""",
    "geo_points": f"""
SELECT * FROM (
  SELECT {clean("geolocation_zip_code_prefix")} AS zip_prefix, geolocation_lat AS lat, geolocation_lng AS lng,
         {clean("geolocation_city", "lower")} AS city, {clean("geolocation_state", "upper")} AS state,
         {flag("geolocation_lat BETWEEN -35 AND 6 AND geolocation_lng BETWEEN -75 AND -30")} AS is_valid
  FROM raw_geolocation) AS p WHERE zip_prefix <> ''""",
    "accented": """
SELECT * REPLACE (CASE WHEN lat > -16 THEN translate(city, 'aei', 'áéí') ELSE city END AS city) FROM geo_points""",
    "geo_counts": """
SELECT zip_prefix, count(*) AS row_cnt, count(*) FILTER (WHERE is_valid = 0) AS invalid_latlng_cnt,
       count(DISTINCT city) AS city_cnt, count(DISTINCT state) AS state_cnt
FROM geo_points GROUP BY zip_prefix""",
    "point_mode": """
SELECT zip_prefix, lat, lng, mode_cnt FROM (
  SELECT zip_prefix, lat, lng, count(*) AS mode_cnt,
         row_number() OVER (PARTITION BY zip_prefix ORDER BY count(*) DESC, lat, lng) AS place
  FROM geo_points WHERE is_valid = 1 GROUP BY zip_prefix, lat, lng) AS r WHERE place = 1""",
    "place_mode": """
SELECT zip_prefix, city, state, place_cnt FROM (
  SELECT zip_prefix, city, state, count(*) AS place_cnt,
         row_number() OVER (PARTITION BY zip_prefix ORDER BY count(*) DESC, city NULLS FIRST, state NULLS FIRST) AS place
  FROM geo_points GROUP BY zip_prefix, city, state) AS r WHERE place = 1""",
    "stg_geolocation": f"""
SELECT zip_prefix AS geolocation_zip_code_prefix, lat AS geolocation_lat, lng AS geolocation_lng,
       city AS geolocation_city, state AS geolocation_state, city || '_' || state AS geolocation_city_state,
       row_cnt, coalesce(mode_cnt, 0) AS mode_cnt, {pct("coalesce(mode_cnt, 0)", "row_cnt")} AS mode_ratio_pct,
       invalid_latlng_cnt, city_cnt, state_cnt, {flag("invalid_latlng_cnt > 0")} AS is_invalid_latlng_exists,
       {flag("city_cnt > 1")} AS is_multi_city, {flag("state_cnt > 1")} AS is_multi_state
FROM geo_counts LEFT JOIN point_mode USING (zip_prefix) LEFT JOIN place_mode USING (zip_prefix)""",
}
