"""Star schema and delivered-order views."""

from oracles.sqltext import flag

DATE_KEY = "CAST(strftime({d}, '%Y%m%d') AS INTEGER)"

TABLES = {
    "order_dates": """
SELECT unnest([CAST(order_purchase_dt AS DATE), CAST(order_approved_dt AS DATE), CAST(order_delivered_carrier_dt AS DATE),
               CAST(order_delivered_customer_dt AS DATE), order_estimated_delivery_dt]) AS d
FROM stg_orders""",
    "bounds": """
SELECT CAST(min(d) - INTERVAL 1 MONTH AS DATE) AS start_date, CAST(max(d) + INTERVAL 1 MONTH AS DATE) AS end_date
FROM order_dates""",
    "days": """
SELECT CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS d FROM bounds""",
    "dim_date": f"""
SELECT {DATE_KEY.format(d="d")} AS date_key, d AS "date", CAST(year(d) AS INTEGER) AS "year",
       CAST(quarter(d) AS INTEGER) AS "quarter", CAST(month(d) AS INTEGER) AS "month", CAST(day(d) AS INTEGER) AS "day",
       strftime(d, '%Y-%m') AS year_month, year(d) || '-Q' || quarter(d) AS year_quarter,
       CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(isodow(d) AS INTEGER) AS day_of_week, dayname(d) AS day_name,
       {flag("isodow(d) >= 6")} AS is_weekend, {flag("day(d) = 1")} AS is_month_start,
       {flag("d = last_day(d)")} AS is_month_end
FROM days""",
    "dim_geolocation": "SELECT * FROM stg_geolocation",
    "dim_customer": "SELECT * FROM stg_customers",
    "dim_product": "SELECT * FROM stg_products",
    "dim_seller": "SELECT * FROM stg_sellers",
    "fact_orders": f"""
SELECT order_id, o.customer_id, {DATE_KEY.format(d="order_purchase_dt")} AS order_purchase_date_key, customer_zip_code_prefix,
       order_status, order_purchase_dt, order_approved_dt, order_delivered_carrier_dt, order_delivered_customer_dt,
       order_estimated_delivery_dt, approve_lead_days, delivery_lead_days, delivery_delay_days, is_delivered, is_canceled
FROM stg_orders AS o LEFT JOIN stg_customers AS c ON c.customer_id = o.customer_id""",
    "fact_order_items": f"""
SELECT i.order_id, order_item_id, order_item_seq, o.customer_id, product_id, i.seller_id,
       {DATE_KEY.format(d="order_purchase_date")} AS order_purchase_date_key, customer_zip_code_prefix, seller_zip_code_prefix,
       price, freight_value, item_total_value
FROM stg_order_items AS i JOIN stg_orders AS o ON o.order_id = i.order_id
LEFT JOIN stg_customers AS c ON c.customer_id = o.customer_id LEFT JOIN stg_sellers AS s ON s.seller_id = i.seller_id""",
    "delivered_orders": """
SELECT order_id, customer_id, customer_zip_code_prefix, order_purchase_date_key, year_month, order_status, is_delivered,
       is_canceled, order_purchase_dt, order_approved_dt, order_delivered_carrier_dt, order_delivered_customer_dt,
       order_estimated_delivery_dt, approve_lead_days, delivery_lead_days, delivery_delay_days
FROM fact_orders JOIN dim_date ON date_key = order_purchase_date_key
WHERE order_status = 'delivered' AND is_delivered = 1""",
    "delivered_items": """
SELECT i.order_id, order_item_id, order_item_seq, o.customer_id, o.customer_zip_code_prefix, product_id, seller_id,
       seller_zip_code_prefix, o.order_purchase_date_key, year_month, price, freight_value, item_total_value
FROM fact_order_items AS i JOIN delivered_orders AS o ON o.order_id = i.order_id""",
    "first_purchase": """
SELECT customer_unique_id, first_purchase_date_key, year_month AS first_purchase_year_month
FROM (SELECT customer_unique_id, min(order_purchase_date_key) AS first_purchase_date_key
      FROM delivered_orders AS o JOIN dim_customer AS c ON c.customer_id = o.customer_id GROUP BY customer_unique_id) AS f
JOIN dim_date ON date_key = first_purchase_date_key""",
}
