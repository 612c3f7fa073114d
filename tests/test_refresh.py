"""Changed orders in stored layers against full builds."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

from tests.shop import raw_shop
from tradewinds.plans.refresh import apply_orders
from tradewinds.plans.warehouse import LAYERS, Warehouse, build_all, open_all

FOLLOWING = ("dim_date", "fact_orders", "fact_order_items", *LAYERS["am"])
D = Decimal


def late_orders(spark):
    raw = raw_shop(spark)
    order = [
        # late, and before all other months of this person; another status; no longer delivered
        ("o20", "c2", "delivered", "2017-02-10 00:00:00", "2017-02-10 00:00:00", "", "2017-02-20 00:00:00", "2017-02-25 00:00:00"),
        ("o4", "c3", "canceled", "2017-03-01 00:00:00", "2017-03-01 10:00:00", "n/a", "", ""),
        ("o6", "c2", "unavailable", "2017-03-31 08:00:00", "2017-03-31 09:00:00", "", "", "later"),
        ("o21", "c1", "delivered", "n/a", "", "", "2017-01-22 00:00:00", ""),
    ]
    item = [
        ("o20", "1", "p1", "s1", "2017-02-12 00:00:00", D("7.00"), D("1.00")),
        ("o6", "1", "p3", "s1", "2017-04-03 00:00:00", D("11.00"), D("5.00")),
    ]
    return spark.createDataFrame(order, raw["orders"].schema), spark.createDataFrame(item, raw["order_items"].schema)


def all_rows(raw, orders, items):
    ids = [r.order_id for r in orders.collect()]
    old = {name: raw[name].filter(~raw[name]["order_id"].isin(ids)) for name in ("orders", "order_items")}
    return {**raw, "orders": old["orders"].union(orders), "order_items": old["order_items"].union(items)}


def same(a, b):
    for name in FOLLOWING:
        left, right = a.table(name), b.table(name)
        assert left.dtypes == right.dtypes, name
        assert Counter(map(tuple, left.collect())) == Counter(map(tuple, right.collect())), name


def test_changed_orders_give_the_tables_of_a_full_build(spark, tmp_path):
    raw = raw_shop(spark)
    stored = build_all(raw, str(tmp_path), buckets=3)
    orders, items = late_orders(spark)
    # the facts of other months can't be read meanwhile
    others = [p for p in (tmp_path / "dm").glob("fact_*/_version=*/year_month=*/*.parquet") if "2017-02" not in str(p) and "2017-03" not in str(p)]
    content = {p: p.read_bytes() for p in others}
    assert len(others) >= 2
    for p in others:
        p.write_bytes(b"damaged")
    apply_orders(stored, str(tmp_path), orders, items)
    for p, b in content.items():
        p.write_bytes(b)
    # opened anew, as sizes of files are remembered
    same(open_all(raw, str(tmp_path)), Warehouse(all_rows(raw, orders, items)))


def test_changes_that_extend_the_calendar_and_changes_twice(spark, tmp_path):
    raw = raw_shop(spark)
    stored = build_all(raw, str(tmp_path))
    orders, items = late_orders(spark)
    far = spark.createDataFrame(
        [("o30", "c1", "canceled", "2018-06-01 00:00:00", "", "", "", ""), ("o31", "c1", "delivered", "2016-06-01 00:00:00", "", "", "2016-06-03 00:00:00", "")],
        orders.schema,
    )
    first = apply_orders(stored, str(tmp_path), orders, items)
    second = apply_orders(first, str(tmp_path), far, items.limit(0))
    third = apply_orders(second, str(tmp_path), orders.limit(0), items.limit(0))
    now = all_rows(all_rows(raw, orders, items), far, items.limit(0))
    same(second, Warehouse(now))
    same(third, Warehouse(now))
