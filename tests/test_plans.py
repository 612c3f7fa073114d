from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from pyspark.sql import functions as F
from tests.shop import raw_shop
from tradewinds.functions import safe_ratio
from tradewinds.operators import joins
from tradewinds.operators.quality import composite_unique_profile
from tradewinds.plans import analysis, kpis, marts, quality_suite, staging
from tradewinds.plans.warehouse import LAYERS, Warehouse, build_all


def by_key(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def shop(spark):
    return Warehouse(raw_shop(spark))


def test_calendar(shop):
    days = shop.dim_date.agg({"date": "min", "date_key": "max"}).first()
    assert tuple(days) == (dt.date(2016, 12, 1), 20170502) or tuple(days) == (20170502, dt.date(2016, 12, 1))
    assert shop.dim_date.count() == 153


def test_facts(shop):
    orders = by_key(shop.fact_orders, "order_id")
    assert orders["o1"]["customer_zip_code_prefix"] == "01000" and orders["o1"]["order_purchase_date_key"] == 20170101
    items = shop.fact_order_items.collect()
    assert {(r["order_id"], r["order_item_id"]) for r in items} == {("o1", "1"), ("o1", "2"), ("o3", " x"), ("o6", "1"), ("o6", "2")}
    assert {r["seller_zip_code_prefix"] for r in items if r["seller_id"] == "s9"} == {None}


def test_delivered_views(shop):
    assert {r["order_id"] for r in shop.vw_delivered_orders.collect()} == {"o1", "o6", "o7"}
    assert shop.vw_delivered_order_items.count() == 4
    first = by_key(shop.vw_customer_first_purchase_month, "customer_unique_id")
    assert {k: r["first_purchase_year_month"] for k, r in first.items()} == {"u1": "2017-01", "u2": "2017-03"}
    history = marts.cohort_order_history(
        shop.vw_customer_first_purchase_month, shop.vw_delivered_orders, shop.dim_customer, ["2017-01"]
    )
    assert {(r["customer_unique_id"], r["order_id"]) for r in history.collect()} == {("u1", "o1"), ("u1", "o7")}


def test_label_from_key_equals_label_from_calendar(shop):
    plain = shop.vw_delivered_orders
    joined = marts.vw_delivered_orders(shop.fact_orders, shop.dim_date)
    assert Counter(plain.select(*joined.columns).collect()) == Counter(joined.collect())
    partial = marts.vw_delivered_orders(shop.fact_orders, shop.dim_date.filter("year_month = '2017-03'"))
    assert [r["order_id"] for r in partial.collect()] == ["o6"]


def test_person_months(shop):
    base = {(r["customer_unique_id"], r["year_month"]): r for r in shop.base_customer_monthly_purchase.collect()}
    assert set(base) == {("u1", "2017-01"), ("u2", "2017-03")}
    one = base["u1", "2017-01"]
    assert (one["order_cnt"], one["item_cnt"], one["gross_revenue"]) == (2, 2, Decimal("12.50"))
    assert (one["month_n"], one["is_new_buyer"], one["is_repeat_buyer"], one["is_active"]) == (0, 1, 0, 1)
    assert base["u2", "2017-03"]["gross_revenue"] == Decimal("160.00")


def test_repeated_order_rows_count_once(shop):
    orders, items = shop.vw_delivered_orders, shop.fact_order_items
    doubled = analysis.base_customer_monthly_purchase(orders.unionByName(orders), items, shop.dim_customer)
    got = by_key(doubled, "customer_unique_id")
    assert got["u1"]["order_cnt"] == 2 and got["u1"]["item_cnt"] == 4


def test_counts_beyond_int(spark):
    rows = [("z", kind, None, None, 1, "c", "s", 2**31 + 5) for kind in (staging.POINT, staging.PLACE)]
    counted = spark.createDataFrame(rows, "zip_prefix string, kind int, lat double, lng double, is_valid int, city string, state string, n long")
    assert counted.groupBy("zip_prefix").agg(*staging._zip_counts()).first()["row_cnt"] == 2**31 + 5
    ratio = spark.range(1).select(safe_ratio(F.lit(10**9), F.lit(3)).alias("r")).first()["r"]
    assert ratio == Decimal("333333333.333333")


RECOMPUTED = """
WITH o AS (
  SELECT order_id, customer_id, order_purchase_date_key // 100 AS m FROM fact_orders WHERE order_status = 'delivered' AND is_delivered = 1
), people AS (
  SELECT c.customer_unique_id AS person, m, count(DISTINCT order_id) AS orders FROM o JOIN dim_customer c USING (customer_id) GROUP BY ALL
), items AS (
  SELECT c.customer_unique_id AS person, o.m, count(*) AS items, sum(i.item_total_value) AS revenue
  FROM fact_order_items i JOIN o ON o.order_id = i.order_id JOIN dim_customer c ON c.customer_id = o.customer_id GROUP BY ALL
)
SELECT person, m, orders, coalesce(items, 0), coalesce(revenue, 0) FROM people LEFT JOIN items USING (person, m)"""


def test_repeated_order_and_customer_rows_have_one_answer(spark, tmp_path):
    raw = raw_shop(spark)
    raw["orders"] = raw["orders"].union(raw["orders"].filter("order_id in ('o1', 'o6')"))
    raw["customers"] = raw["customers"].union(raw["customers"].filter("customer_id = 'c2'"))
    lazy, stored = Warehouse(raw), build_all(raw, str(tmp_path))

    def totals(w):
        columns = ("customer_unique_id", "year_month", "order_cnt", "item_cnt", "gross_revenue")
        return {tuple(r) for r in w.base_customer_monthly_purchase.select(*columns).collect()}

    assert totals(lazy) == totals(stored)
    con = duckdb.connect()
    for name in ("fact_orders", "fact_order_items", "dim_customer"):
        con.register(name, lazy.table(name).toArrow())
    again = {(p, f"{m // 100}-{m % 100:02}", n, i, r) for p, m, n, i, r in con.sql(RECOMPUTED).fetchall()}
    assert totals(lazy) == again


def test_one_month_opens_one_folder(spark, tmp_path):
    stored = build_all(raw_shop(spark), str(tmp_path))
    january = stored.vw_delivered_orders.filter("year_month = '2017-01'")
    plan = january._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*year_month", plan)
    assert {r["order_id"] for r in january.collect()} == {"o1", "o7"}
    assert list((tmp_path / "dm" / "fact_order_items").glob("_version=*/year_month=2017-01"))


def test_core_kpis(shop):
    core = by_key(shop.kpi_monthly_core, "year_month")
    assert sorted(core) == ["2016-12", "2017-01", "2017-02", "2017-03", "2017-04", "2017-05"]
    assert core["2017-01"]["aov"] == Decimal("6.25") and core["2017-01"]["repeat_buyer_rate"] == Decimal("0.000000")
    quiet = core["2017-02"]
    assert (quiet["gross_revenue"], quiet["order_cnt"], quiet["aov"], quiet["repeat_buyer_rate"]) == (0, 0, None, None)


def test_cancellation(shop):
    kpi = by_key(shop.kpi_monthly_cancellation, "year_month")
    assert kpi["2017-02"]["cancel_rate"] == Decimal("1.000000")
    march = kpi["2017-03"]
    assert (march["total_orders"], march["canceled_orders"], march["unavailable_orders"], march["failed_orders"]) == (3, 0, 1, 1)
    assert march["failed_rate"] == Decimal("0.333333") and kpi["2017-04"]["failed_rate"] is None


def test_cohorts(shop):
    core = shop.cohort_monthly_core
    rows = {(r["cohort_year_month"], r["month_n"]): r for r in core.collect()}
    assert len(rows) == 8
    assert rows["2017-01", 4]["cum_gross_revenue"] == Decimal("12.50") and rows["2017-01", 4]["cohort_active_buyers"] == 0
    assert rows["2017-01", 0]["cohort_retention_rate"] == 1 and rows["2017-01", 1]["cohort_retention_rate"] == 0
    grid = analysis.cohort_matrix(shop.base_customer_monthly_purchase, analysis.last_calendar_month(shop.dim_date))
    assert Counter(map(tuple, grid.collect())) == Counter(
        map(tuple, core.select("cohort_year_month", "year_month", "month_n").collect())
    )
    wide = by_key(analysis.cohort_pivot(core, "revenue"), "cohort_year_month")
    assert wide["2017-03"]["m0_revenue"] == Decimal("160.00") and wide["2017-03"]["m12_revenue"] == 0
    assert by_key(analysis.cohort_pivot(core, "aov"), "cohort_year_month")["2017-01"]["m1_aov"] is None


def test_documented_kpis(shop):
    total = kpis.kpi_sales_summary(shop.vw_delivered_order_items).first()
    assert (total["gross_revenue"], total["item_cnt"], total["order_cnt"]) == (Decimal("172.50"), 4, 2)
    assert total["avg_item_total"] == Decimal("57.50")  # the item without a total is not averaged
    flags = by_key(
        kpis.join_integrity_flags(shop.stg_orders, shop.stg_order_items, shop.stg_order_payments, shop.stg_order_reviews),
        "order_id",
    )
    assert tuple(flags["o1"])[1:] == (0, 0, 1) and tuple(flags["o2"])[1:] == (1, 1, 0)
    regions = by_key(kpis.revenue_by_region(shop.vw_delivered_order_items, shop.dim_geolocation, "seller"), "city_state")
    assert regions[None]["gross_revenue"] == Decimal("105.00")  # unknown seller and uncovered zip stay visible
    repeat = kpis.overall_repeat_rate(shop.base_customer_monthly_purchase).first()
    assert tuple(repeat) == (2, 1, Decimal("0.500000"))
    split = by_key(kpis.orders_vs_aov_decomposition(shop.kpi_monthly_core), "year_month")
    assert tuple(split["2017-02"])[1:] == (Decimal("-12.50"), Decimal("-12.50"), Decimal("0.00"))
    assert split["2017-03"]["order_effect"] is None


def test_written_layers_equal_lazy_plans(spark, shop, tmp_path):
    written = build_all(raw_shop(spark), str(tmp_path))
    for tables in LAYERS.values():
        for name in tables:
            lazy, stored = shop.table(name), written.table(name)
            assert lazy.dtypes == stored.dtypes, name
            assert Counter(map(tuple, lazy.collect())) == Counter(map(tuple, stored.collect())), name
    assert (tmp_path / "am" / "cohort_monthly_core").is_dir()


def test_consolidated_report(shop):
    report = {(r["section"], r["subject"], r["check_name"]): r for r in quality_suite.run_qc(shop).collect()}
    lost = report["references", "stg_order_items", "order_items.order_id -> orders"]
    assert (lost["severity"], lost["value"], lost["passed"]) == ("fail", Decimal("1.00"), False)
    zips = report["references", "stg_customers", "customers.zip -> geolocation"]
    assert (zips["severity"], zips["value"], zips["passed"]) == ("monitor", Decimal("1.00"), True)
    assert report["keys", "stg_orders", "repeated order_id"]["passed"]
    assert report["row counts", "geolocation_zips", "staging - raw"]["value"] <= 0


def test_items_grouped_by_order_are_dealt_by_the_bytes_of_the_input(spark, tmp_path, monkeypatch, large_sides):
    items = spark.range(4000).selectExpr(
        "cast(id div 4 as string) as order_id", "cast(id % 4 as string) as order_item_id", "'p' as product_id", "cast(id % 3 as string) as seller_id",
        "'2017-03-01 10:00:00' as shipping_limit_date", "cast(10 as decimal(10,2)) as price", "cast(1 as decimal(10,2)) as freight_value",
    )
    items.write.parquet(f"{tmp_path}/items")
    raw = {**raw_shop(spark), "order_items": spark.read.parquet(f"{tmp_path}/items")}
    orders = raw["orders"].limit(1).drop("order_id").join(spark.range(1000).selectExpr("cast(id as string) as order_id")).select(raw["orders"].columns)
    orders.write.parquet(f"{tmp_path}/orders")
    raw["orders"] = spark.read.parquet(f"{tmp_path}/orders")
    expected = kpis.cancellation_breakdown(kpis.orders_by_seller(Warehouse(raw).fact_orders, Warehouse(raw).fact_order_items), "seller_id").collect()
    monkeypatch.setattr(joins, "DEALT_FROM", 0)
    monkeypatch.setattr(joins, "DEALT_BYTES", 1 << 9)
    shop = Warehouse(raw)
    pairs = kpis.orders_by_seller(shop.fact_orders, shop.fact_order_items_by_order)
    most = pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 1000
    assert sorted(kpis.cancellation_breakdown(pairs, "seller_id").collect()) == sorted(expected) and len(expected) == 3
    found = composite_unique_profile(shop.fact_order_items_by_order, ["order_id", "order_item_id"])
    assert tuple(found.first()) == (4000, 4000, 0, 0) and "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
