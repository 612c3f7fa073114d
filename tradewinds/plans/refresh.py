"""Late and changed orders brought into stored layers month by month.

The facts and the totals of persons are stored by month, and a month of the totals depends on that month of the facts
alone. So changed orders touch the months they fall into, of which the facts are read and written anew; first months of
persons, cohorts and KPIs follow from the totals, which are far smaller than the facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewinds.operators.calendar import dense_months
from tradewinds.operators.joins import is_small
from tradewinds.plans import analysis, marts, staging
from tradewinds.plans.warehouse import MONTH_BOUNDS, PERSON_MONTHS, Warehouse, open_all
from tradewinds.sources.sinks import scratch_folder
from tradewinds.sources.storage import overwrite_partitions, overwrite_table

MONTH = "year_month"


def apply_orders(stored: Warehouse, storage: str, orders: DataFrame, order_items: DataFrame) -> Warehouse:
    """Bring raw rows of orders into the stored star schema and analysis tables below ``storage``.

    ``orders`` are new orders, or known ones with other values but the same month of purchase; ``order_items`` are all
    items of these orders, which replace those known. Facts, calendar and analysis tables then are those of a full
    build over all rows; of the facts only the months of these orders are read. Customers and sellers must be known.
    Staging tables stay as they are until the next full build. Orders without a purchase time are left out, as always.
    """
    spark = orders.sparkSession
    changed = overwrite_table(staging.stg_orders(orders), scratch_folder(spark, "changed-orders"))
    items = overwrite_table(staging.stg_order_items(order_items), scratch_folder(spark, "changed-items"))
    new_orders = marts.with_month(marts.fact_orders(changed, stored.stg_customers), "order_purchase_date_key")
    new_items = marts.fact_order_items(items, changed, stored.stg_customers, stored.stg_sellers)
    new_items = marts.with_month(new_items, "order_purchase_date_key")
    # a row a month
    months = sorted(r[0] for r in new_orders.select(MONTH).distinct().collect())
    if not months:
        return stored
    ids = changed.select("order_id").distinct()
    ids = F.broadcast(ids) if is_small(ids) else ids

    def merged(fact: DataFrame, new: DataFrame) -> DataFrame:
        return fact.filter(F.col(MONTH).isin(months)).join(ids, "order_id", "left_anti").unionByName(new)

    folders = [f"{MONTH}={m}" for m in months]
    by = ["order_purchase_date_key"]
    facts = overwrite_partitions(merged(stored.fact_orders_by_month, new_orders), stored.path("fact_orders"), by, folders)
    lines = overwrite_partitions(merged(stored.fact_order_items_by_month, new_items), stored.path("fact_order_items"), by, folders)
    touched, touched_lines = (f.filter(F.col(MONTH).isin(months)) for f in (facts, lines))
    totals = analysis.person_months(marts.vw_delivered_orders(touched), touched_lines, stored.dim_customer)
    people = overwrite_partitions(totals, f"{storage}/{PERSON_MONTHS}", also=folders)

    bounds = stored.month_bounds.filter(~F.col(MONTH).isin(months)).unionByName(marts.month_bounds(touched))
    bounds = overwrite_table(bounds, f"{storage}/{MONTH_BOUNDS}")
    dates = stored.keep("dim_date", marts.dim_date_over(bounds))
    base = stored.keep("base_customer_monthly_purchase", analysis.with_cohorts(people))
    stored.keep("kpi_monthly_core", analysis.kpi_monthly_core(dates, base))
    stored.keep("cohort_monthly_core", analysis.cohort_monthly_core(dates, base))
    # months that the calendar gains or loses change with it
    calendar = dense_months(dates)
    kept = stored.kpi_monthly_cancellation.filter(~F.col(MONTH).isin(months)).join(calendar, MONTH, "left_semi")
    again = analysis.kpi_monthly_cancellation(touched, dates).join(kept.select(MONTH), MONTH, "left_anti")
    stored.keep("kpi_monthly_cancellation", kept.unionByName(again))
    return open_all(stored.raw, storage)

