"""Raw marketplace tables derived from the driver tables."""

STATES = "substring('SPRJMGPRRS', CAST(1 + 2 * ({n} % 5) AS INTEGER), 2)"

TABLES = {
    "raw_orders": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
       CASE WHEN o_orderstatus = 'F' THEN ' Delivered' WHEN o_orderstatus = 'O' THEN 'shipped'
            WHEN o_orderkey % 3 = 0 THEN 'canceled' WHEN o_orderkey % 3 = 1 THEN 'unavailable' ELSE 'processing' END
         || CASE WHEN o_orderkey % 10 = 0 THEN chr(13) ELSE '' END AS order_status,
       CASE WHEN o_orderkey % 997 = 5 THEN 'n/a' ELSE CAST(o_orderdate AS VARCHAR) END AS order_purchase_timestamp,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_orderdate + INTERVAL 26 HOUR AS VARCHAR) END AS order_approved_at,
       coalesce(CAST(ship_from AS VARCHAR), '') AS order_delivered_carrier_date,
       CASE WHEN o_orderstatus = 'F' OR o_orderkey % 50 = 1 THEN coalesce(CAST(ship_to AS VARCHAR), '') ELSE '' END
         AS order_delivered_customer_date,
       CAST(o_orderdate + INTERVAL 30 DAY AS VARCHAR) AS order_estimated_delivery_date
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS ship_from, max(l_shipdate) AS ship_to
                       FROM lineitem GROUP BY l_orderkey) AS shipped ON l_orderkey = o_orderkey""",
    "raw_order_items": """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS VARCHAR) AS order_item_id,
       CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
       CAST(l_shipdate AS VARCHAR) AS shipping_limit_date,
       CAST(l_extendedprice AS DECIMAL(10,2)) AS price, CAST(l_quantity AS DECIMAL(10,2)) AS freight_value
FROM lineitem""",
    "raw_order_payments": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(part_no AS INTEGER) AS payment_sequential,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Credit_Card ' WHEN '2-HIGH' THEN 'boleto' WHEN '3-MEDIUM' THEN 'voucher'
            WHEN '5-LOW' THEN 'debit_card' ELSE 'not_defined' END AS payment_type,
       CAST(o_orderkey % 25 AS INTEGER) AS payment_installments,
       CASE WHEN o_orderkey % 500 = 3 THEN CAST(0 AS DECIMAL(10,2)) ELSE CAST(o_totalprice AS DECIMAL(10,2)) END AS payment_value
FROM orders, (VALUES (1), (2)) AS parts(part_no)
WHERE o_orderkey % 1000 <> 7 AND (part_no = 1 OR o_orderkey % 20 = 0)""",
    "raw_order_reviews": """
SELECT 'r' || CAST(o_orderkey AS VARCHAR) AS review_id, CAST(o_orderkey AS VARCHAR) AS order_id,
       CAST(o_orderkey % 5 + 1 AS INTEGER) AS review_score,
       CASE WHEN o_orderkey % 3 = 0 THEN ' title' ELSE ' ' END AS review_comment_title,
       CASE WHEN o_orderkey % 4 = 0
              THEN o_orderpriority || ', "quick"' || chr(10) || 'and "", well,' || chr(10) || chr(10) || 'packed' || chr(13)
            WHEN o_orderkey % 2 = 0 THEN o_orderpriority || chr(13) ELSE '' END AS review_comment_message,
       CAST(CASE WHEN o_orderkey % 40 = 0 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 12 DAY END AS VARCHAR)
         AS review_creation_date,
       CAST(o_orderdate + INTERVAL 15 DAY AS VARCHAR) AS review_answer_timestamp
FROM orders WHERE o_orderkey % 7 <> 0""",
    "raw_customers": f"""
SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
       'u' || CAST(c_custkey - c_custkey % 2 AS VARCHAR) AS customer_unique_id,
       lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
       ' ' || c_mktsegment AS customer_city,
       lower({STATES.format(n="c_nationkey")}) || chr(13) AS customer_state
FROM customer""",
    "raw_sellers": f"""
SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
       CASE WHEN s_suppkey % 9 = 4 THEN ' ' ELSE 'City ' || CAST(s_nationkey AS VARCHAR) END AS seller_city,
       {STATES.format(n="s_nationkey")} AS seller_state
FROM supplier""",
    "raw_products": """
SELECT CAST(p_partkey AS VARCHAR) AS product_id,
       CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_type || chr(13) END AS product_category_name,
       CAST(length(p_name) AS INTEGER) AS product_name_length, CAST(p_size * 10 AS INTEGER) AS product_description_length,
       CAST(p_partkey % 6 + 1 AS INTEGER) AS product_photos_qty,
       CAST(CASE WHEN p_partkey % 100 = 1 THEN 0 ELSE p_size * 100 END AS INTEGER) AS product_weight_g,
       CAST(CASE WHEN p_partkey % 90 = 2 THEN NULL ELSE p_size END AS INTEGER) AS product_length_cm,
       CAST(p_size % 10 + 2 AS INTEGER) AS product_height_cm, CAST(p_size % 7 + 6 AS INTEGER) AS product_width_cm
FROM part""",
    "raw_translation": """
SELECT DISTINCT p_type AS product_category_name, 'en_' || lower(p_type) AS product_category_name_english
FROM part WHERE p_type <> 'ECONOMY'""",
    "raw_geolocation": f"""
SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS geolocation_zip_code_prefix,
       CAST(c_custkey % 45 - 37 AS DECIMAL(10,6)) AS geolocation_lat,
       CAST(-30 - c_custkey % 5 AS DECIMAL(10,6)) AS geolocation_lng,
       CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) || chr(13) END AS geolocation_city,
       CASE WHEN c_custkey % 30 = 0 THEN 'SP' ELSE {STATES.format(n="c_nationkey")} END AS geolocation_state
FROM customer WHERE c_nationkey <> 24""",
}
