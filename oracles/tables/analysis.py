"""Monthly KPIs and cohorts."""

from oracles.sqltext import flag, ratio

MONEY = "DECIMAL(18,2)"
MONTHS_BETWEEN = (
    "CAST(date_diff('month', CAST({a} || '-01' AS DATE), CAST({b} || '-01' AS DATE)) AS INTEGER)"
)
CANCEL_RATES = ", ".join(
    f"{ratio(num, 'total_orders')} AS {name}"
    for num, name in [
        ("canceled_orders", "cancel_rate"),
        ("unavailable_orders", "unavailable_rate"),
        ("failed_orders", "failed_rate"),
    ]
)
CANCEL_COUNTS = """count(DISTINCT order_id) AS total_orders,
       count(DISTINCT order_id) FILTER (WHERE order_status = 'canceled') AS canceled_orders,
       count(DISTINCT order_id) FILTER (WHERE order_status = 'unavailable') AS unavailable_orders,
       count(DISTINCT order_id) FILTER (WHERE order_status IN ('canceled', 'unavailable')) AS failed_orders"""

TABLES = {
    "person_orders": """
SELECT customer_unique_id, year_month, count(DISTINCT order_id) AS order_cnt
FROM delivered_orders AS o JOIN dim_customer AS c ON c.customer_id = o.customer_id GROUP BY customer_unique_id, year_month""",
    "person_items": f"""
SELECT customer_unique_id, year_month, count(*) AS item_cnt, CAST(sum(item_total_value) AS {MONEY}) AS gross_revenue
FROM delivered_items AS i JOIN dim_customer AS c ON c.customer_id = i.customer_id GROUP BY customer_unique_id, year_month""",
    "base": f"""
SELECT o.customer_unique_id, o.year_month, first_purchase_year_month AS cohort_year_month,
       {MONTHS_BETWEEN.format(a="first_purchase_year_month", b="o.year_month")} AS month_n,
       order_cnt, coalesce(item_cnt, 0) AS item_cnt, CAST(coalesce(gross_revenue, 0) AS {MONEY}) AS gross_revenue,
       {flag("order_cnt > 0")} AS is_active, {flag("o.year_month = first_purchase_year_month")} AS is_new_buyer,
       {flag("o.year_month > first_purchase_year_month")} AS is_repeat_buyer
FROM person_orders AS o
LEFT JOIN person_items AS i ON i.customer_unique_id = o.customer_unique_id AND i.year_month = o.year_month
JOIN first_purchase AS f ON f.customer_unique_id = o.customer_unique_id""",
    "months": "SELECT DISTINCT year_month FROM dim_date",
    "kpi_core": f"""
SELECT m.year_month, CAST(coalesce(gross_revenue, 0) AS {MONEY}) AS gross_revenue, coalesce(order_cnt, 0) AS order_cnt,
       coalesce(active_buyers, 0) AS active_buyers, {ratio("gross_revenue", "order_cnt", 2, MONEY, 2)} AS aov,
       coalesce(repeat_buyers, 0) AS repeat_buyers, {ratio("repeat_buyers", "active_buyers")} AS repeat_buyer_rate
FROM months AS m LEFT JOIN (
  SELECT year_month, sum(gross_revenue) AS gross_revenue, CAST(sum(order_cnt) AS BIGINT) AS order_cnt,
         count(DISTINCT customer_unique_id) AS active_buyers,
         count(DISTINCT customer_unique_id) FILTER (WHERE is_repeat_buyer = 1) AS repeat_buyers
  FROM base GROUP BY year_month) AS b ON b.year_month = m.year_month""",
    "kpi_cancel": f"""
SELECT year_month, coalesce(total_orders, 0) AS total_orders, coalesce(canceled_orders, 0) AS canceled_orders,
       coalesce(unavailable_orders, 0) AS unavailable_orders, coalesce(failed_orders, 0) AS failed_orders, {CANCEL_RATES}
FROM months LEFT JOIN (SELECT year_month, {CANCEL_COUNTS}
  FROM fact_orders JOIN dim_date ON date_key = order_purchase_date_key GROUP BY year_month) AS c USING (year_month)""",
    "cohort_values": f"""
SELECT cohort_year_month, year_month, month_n, count(DISTINCT customer_unique_id) AS cohort_active_buyers,
       CAST(sum(order_cnt) AS BIGINT) AS cohort_order_cnt, CAST(sum(gross_revenue) AS {MONEY}) AS cohort_gross_revenue
FROM base GROUP BY cohort_year_month, year_month, month_n""",
    "cohort_sizes": """
SELECT cohort_year_month, count(DISTINCT customer_unique_id) AS cohort_size FROM base WHERE month_n = 0 GROUP BY cohort_year_month""",
    "cohort_grid": f"""
SELECT cohort_year_month, year_month, {MONTHS_BETWEEN.format(a="cohort_year_month", b="year_month")} AS month_n
FROM (SELECT DISTINCT cohort_year_month FROM base) AS c JOIN months ON year_month >= cohort_year_month""",
    "cohort_core": f"""
SELECT *, CAST(sum(cohort_gross_revenue) OVER so_far AS {MONEY}) AS cum_gross_revenue,
       CAST(sum(cohort_order_cnt) OVER so_far AS BIGINT) AS cum_order_cnt
FROM (
  SELECT g.cohort_year_month, g.year_month, g.month_n, cohort_size, coalesce(cohort_active_buyers, 0) AS cohort_active_buyers,
         coalesce(cohort_order_cnt, 0) AS cohort_order_cnt,
         CAST(coalesce(cohort_gross_revenue, 0) AS {MONEY}) AS cohort_gross_revenue,
         {ratio("coalesce(cohort_active_buyers, 0)", "cohort_size")} AS cohort_retention_rate,
         {ratio("cohort_gross_revenue", "cohort_order_cnt", 2, MONEY, 2)} AS cohort_aov
  FROM cohort_grid AS g JOIN cohort_sizes AS s ON s.cohort_year_month = g.cohort_year_month
  LEFT JOIN cohort_values AS v ON v.cohort_year_month = g.cohort_year_month AND v.year_month = g.year_month) AS filled
WINDOW so_far AS (PARTITION BY cohort_year_month ORDER BY month_n)""",
}
