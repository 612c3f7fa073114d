from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tests.shop import raw_shop
from tradewinds.plans import staging
from tradewinds.plans.warehouse import Warehouse


def by_key(df, key):
    return {r[key]: r for r in df.collect()}


def test_stg_orders(spark):
    orders = by_key(Warehouse(raw_shop(spark)).stg_orders, "order_id")
    assert set(orders) == {"o1", "o2", "o3", "o4", "o5", "o6", "o7"}  # the one without a purchase time is gone
    o1 = orders["o1"]
    assert o1["order_status"] == "delivered" and o1["is_delivered"] == 1 and o1["is_canceled"] == 0
    assert o1["order_purchase_dt"] == dt.datetime(2017, 1, 1, 23, 50) and o1["order_year_month"] == "2017-01"
    assert (o1["order_year"], o1["order_month"]) == (2017, 1)
    assert (o1["approve_lead_days"], o1["delivery_lead_days"], o1["delivery_delay_days"]) == (1, 9, -5)
    assert orders["o2"]["is_status_inconsistent"] == 1 and orders["o2"]["is_delivered"] == 0
    assert orders["o3"]["is_status_inconsistent"] == 1 and orders["o3"]["is_canceled"] == 1
    assert orders["o4"]["is_carrier_dt_missing"] == 1
    assert orders["o5"]["is_time_inconsistent"] == 1 and orders["o5"]["approve_lead_days"] is None
    assert orders["o6"]["delivery_delay_days"] is None and orders["o6"]["delivery_lead_days"] is not None


def test_addresses(spark):
    w = Warehouse(raw_shop(spark))
    customers, sellers = by_key(w.stg_customers, "customer_id"), by_key(w.stg_sellers, "seller_id")
    assert customers["c1"]["customer_city_state"] == "rio_RJ" and customers["c1"]["customer_zip_code_prefix"] == "01000"
    assert customers["c4"]["customer_city"] == "" and customers["c4"]["customer_city_state"] == "_SP"
    assert "" not in customers
    assert sellers["s2"]["seller_city"] is None and sellers["s2"]["seller_city_state"] is None


def test_items_payments_reviews(spark):
    w = Warehouse(raw_shop(spark))
    items = {(r["order_id"], r["order_item_id"]): r for r in w.stg_order_items.collect()}
    assert items["o1", "1"]["item_total_value"] == Decimal("12.50") and items["o1", "1"]["order_item_seq"] == 1
    assert items["o1", "2"]["item_total_value"] is None
    assert items["o3", " x"]["order_item_seq"] is None and items["o3", " x"]["shipping_limit_dt"] is None
    payments = w.stg_order_payments.collect()
    assert {(r["payment_type"], r["is_installments_zero"], r["is_payment_value_zero"]) for r in payments} == {
        ("credit_card", 0, 0),
        ("boleto", 1, 1),
    }
    reviews = by_key(w.stg_order_reviews, "review_id")
    assert set(reviews) == {"r1", "r2"}
    assert (reviews["r1"]["is_title_blank"], reviews["r1"]["is_message_blank"]) == (1, 0)
    assert reviews["r1"]["review_comment_message"] == "Nice"


def test_products(spark):
    products = by_key(Warehouse(raw_shop(spark)).stg_products, "product_id")
    assert products["p1"]["product_volume_cm3"] == 8_000_000_000 and products["p1"]["product_category_name_en"] == "toys"
    flags = {k: (r["is_category_blank"], r["is_category_en_unmapped"], r["is_weight_zero"]) for k, r in products.items()}
    assert flags == {"p1": (0, 0, 0), "p2": (1, 0, 1), "p3": (0, 1, 0)}
    assert products["p2"]["product_volume_cm3"] is None


def test_geolocation(spark):
    raw = raw_shop(spark)
    zips = by_key(Warehouse(raw).stg_geolocation, "geolocation_zip_code_prefix")
    assert set(zips) == {"01000", "02000", "03000"}
    z = zips["01000"]  # two points tie: the smaller latitude wins
    assert (z["geolocation_lat"], z["geolocation_lng"]) == (Decimal("-20.000000"), Decimal("-40.000000"))
    assert (z["row_cnt"], z["mode_cnt"], z["invalid_latlng_cnt"]) == (5, 2, 1)
    assert z["mode_ratio_pct"] == Decimal("40.00") and z["geolocation_city_state"] == "rio_RJ"
    assert (z["is_multi_city"], z["is_multi_state"], z["is_invalid_latlng_exists"]) == (1, 0, 1)
    for zip_ in ("02000", "03000"):  # only points off the map, only unknown points
        assert zips[zip_]["geolocation_lat"] is None and zips[zip_]["mode_cnt"] == 0
        assert zips[zip_]["invalid_latlng_cnt"] == zips[zip_]["row_cnt"]
    points = staging.geo_points(raw["geolocation"])
    pieces = staging.geo_assemble(
        staging.geo_zip_agg(points), staging.geo_point_mode(points), staging.geo_place_mode(points)
    )
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, zips.values()))


def test_geolocation_with_collation(spark):
    rows = [("01000", -20, -40, c, "SP") for c in ("são paulo", "sao paulo", "SAO PAULO", "santos", "santos")]
    df = spark.createDataFrame(
        [(z, Decimal(a), Decimal(b), c, s) for z, a, b, c, s in rows], raw_shop(spark)["geolocation"].schema
    )
    plain, folded = staging.stg_geolocation(df).first(), staging.stg_geolocation(df, "UNICODE_CI_AI").first()
    assert (plain["geolocation_city"], plain["city_cnt"]) == ("santos", 3)
    assert (folded["geolocation_city"], folded["city_cnt"]) == ("sao paulo", 2)


def test_times_are_parsed_once(spark, tmp_path):
    raw = raw_shop(spark)
    for name, stage, times in (("order_items", staging.stg_order_items, 1), ("order_reviews", staging.stg_order_reviews, 2)):
        raw[name].write.parquet(f"{tmp_path}/{name}")
        df = stage(spark.read.parquet(f"{tmp_path}/{name}"))
        # every column of the result is asked for, as the reports over all columns do
        assert df._jdf.queryExecution().optimizedPlan().toString().count("as timestamp_ntz)") == times
        lazy = {tuple(r) for r in stage(raw[name]).collect()}
        assert {tuple(r) for r in df.collect()} == lazy and len(lazy) > 0
