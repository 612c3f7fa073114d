from __future__ import annotations

from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from tradewinds.operators import quality as qc


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_key_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("", 2), (None, 3)], "k string, n int")
    assert tuple(qc.unique_key_profile(df, "k").first()) == (5, 3, 2, 2)
    assert tuple(qc.unique_key_profile(df, "n").first()) == (5, 3, 2, 1)
    assert tuple(qc.composite_unique_profile(df, ["k", "n"]).first()) == (5, 2, 3, 2)
    assert qc.duplicate_key_groups(df, ["k", "n"]).first()[0] == 1


def test_flag_snapshot(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (None, 1), (2, 1)], "is_x int, other int")
    assert rows(qc.flag_snapshot({"t": df})) == Counter({("t", "is_x", 4, 1, 1, Decimal("25.00")): 1})


def test_orphans_ignore_null_keys_unless_asked(spark):
    child = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "fk string")
    parent = spark.createDataFrame([("a",), ("b",), (None,)], "pk string")
    assert qc.orphan_count(child, "fk", parent, "pk").first()[0] == 1
    assert qc.orphan_count(child, "fk", parent, "pk", skip_null=False).first()[0] == 2
    assert tuple(qc.coverage_pct(child, "fk", parent, "pk").first()) == (3, 1, Decimal("66.67"), Decimal("33.33"))
    assert tuple(qc.coverage_pct(child, "fk", parent, "pk", skip_null=False).first())[:2] == (4, 2)
    drill = qc.orphan_drilldown(child, "fk", parent, "pk", spark.createDataFrame([("x",)], "k string"), "k")
    assert rows(drill) == Counter({("x", 1, 1): 1})
    empty = qc.coverage_pct(child.limit(0), "fk", parent, "pk").first()
    assert tuple(empty) == (0, 0, None, None)


def test_null_blank_and_numeric_profiles(spark):
    df = spark.createDataFrame([(None, None), ("", 0), (" ", -1), ("x", 5)], "t string, n int")
    assert rows(qc.null_blank_counts(df, ["t", "n"])) == Counter({("t", 1, 1, 2): 1, ("n", 1, 0, 1): 1})
    assert rows(qc.null_blank_counts(df, ["t"], cleaned=True)) == Counter({("t", 1, 2, 3): 1})
    assert rows(qc.numeric_profile(df, ["n"])) == Counter({("n", 1, 1, 1, Decimal(-1), Decimal(5)): 1})


def test_shares_and_group_sizes(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    assert rows(qc.value_share(df, "v")) == Counter({("a", 2, Decimal("66.67")): 1, ("b", 1, Decimal("33.33")): 1})
    assert rows(qc.count_of_counts(df, "v")) == Counter({(2, 1): 1, (1, 1): 1})
    assert [tuple(r) for r in qc.top_n_groups(df, "v", 1).collect()] == [("a", 2)]


def test_geo_out_of_bounds_with_unknown_coordinates(spark):
    df = spark.createDataFrame([(0, -50), (50, -50), (None, -50), (None, 0), (0, None)], "lat int, lng int")
    got = qc.geo_out_of_bounds(df, "lat", "lng", (-35, 6), (-75, -30))
    assert rows(got) == Counter({(50, -50): 1, (None, 0): 1})


def test_derived_and_flag_rules(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (1, None, 5), (1, 2, None)], "a int, b int, c int")
    got = qc.derived_consistency(df, "c", F.col("a") + F.col("b"), ["a", "b"])
    assert tuple(got.first()) == (1, 1, 1)
    flags = spark.createDataFrame([(1, 5), (0, 5), (0, 0)], "f int, n int")
    assert rows(qc.flag_rule_consistency(flags, {"r": ("f", F.col("n") > 0)})) == Counter({("r", 1): 1})


def test_layer_comparisons(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, None, 6)], "k int, t string, n int")
    b = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (3, "z", 1)], "k int, t string, n int")
    assert tuple(qc.copy_mismatch(a, b, "k", ["t", "n"]).first()) == (1, 1, 0)
    assert qc.copy_mismatch(a, a, "k", ["t", "n"]).first()[0] == 0
    assert rows(qc.row_count_reconcile({"e": (a, b)})) == Counter({("e", 2, 3, 1): 1})
    assert rows(qc.view_vs_source(b, a, ["k"], ["n"], missing_as=0)) == Counter({(3, 1, 0, 1): 1})
    assert qc.view_vs_source(b, a, ["k"], ["n"]).count() == 0


def test_cohort_invariants_find_planted_errors(spark):
    data = [("c", 0, 10, 10, 1, 5), ("c", 1, 3, 10, 1, 4), ("c", 3, 2, 11, 1, 9)]
    df = spark.createDataFrame(data, "g string, n int, v int, size int, one int, cum int")
    assert rows(qc.sequence_gap(df, "g", "n")) == Counter({("c", 3, 2): 1})
    assert rows(qc.constant_within_group(df, "g", "size")) == Counter({("c", 10, 11): 1})
    assert qc.constant_within_group(df, "g", "one").count() == 0
    assert rows(qc.monotone_cumulative(df, "g", "n", "cum")) == Counter({("c", 1, 4, 5): 1})
    assert rows(qc.last_cumulative_equals_total(df, "g", "n", "cum", "v")) == Counter({("c", 9, 15): 1})
    assert qc.sum_identity(df, "n", ["v", "one"], "cum").count() == 2


def test_event_order(spark):
    orders = spark.sql("select 'o' as k, timestamp_ntz'2017-01-02 00:00:00' as t")
    times = "('o', '2017-01-01 00:00:30'), ('o', '2017-01-01 23:59:30'), ('o', '2017-01-03 00:00:00'), ('x', '2016-01-01 00:00:00')"
    child = spark.sql(f"select k, cast(t as timestamp_ntz) as ct from values {times} as v(k, t)")
    assert tuple(qc.cross_table_event_order(child, "ct", orders, "t", "k").first()) == (2, 1, -1439, 0)
    assert rows(qc.event_gap_histogram(child, "ct", orders, "t", "k")) == Counter({(-1439, 1): 1, (0, 1): 1})
    nothing = qc.cross_table_event_order(child.limit(0), "ct", orders, "t", "k").first()
    assert tuple(nothing) == (0, 0, None, None)


def final_plan(df):
    """The plan as it was run, without the one it began with."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_references_read_every_table_once(spark, tmp_path, large_sides):
    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    orders = stored("orders", [("o1", 1), ("o2", 2), (None, 3)], "order_id string, customer int")
    items = stored("items", [("o1", 5), ("o9", 5), ("o9", 6), (None, 7), ("o2", None)], "order_id string, product long")
    products = stored("products", [(5,), (5,), (8,)], "product int")
    customers = stored("customers", [(1,), (3,)], "id int")
    rules = {
        "items.order": ("items", items, "order_id", orders, "order_id"),
        "items.product": ("items", items, "product", products, "product"),
        "orders.customer": ("orders", orders, "customer", customers, "id"),
        "orders.order": ("orders", orders, "order_id", items, "order_id"),
    }
    got = qc.referential_summary(rules)
    assert {r["rule_name"]: (r["table_name"], r["orphan_cnt"]) for r in got.collect()} == {
        "items.order": ("items", 2), "items.product": ("items", 2), "orders.customer": ("orders", 1), "orders.order": ("orders", 0)
    }
    plan = final_plan(got)
    assert plan.count("FileScan") == 4 and plan.count("Exchange hashpartitioning") == 1
    none = qc.referential_summary({r: (t, c.limit(0), ck, p, pk) for r, (t, c, ck, p, pk) in rules.items()})
    assert {r["orphan_cnt"] for r in none.collect()} == {0}


def test_equal_copies_move_no_row(spark, tmp_path, large_sides):
    rows = spark.range(5000).select("id", (F.col("id") % 7).cast("string").alias("t"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    rows.write.parquet(str(tmp_path / "a"))
    rows.repartition(5).write.parquet(str(tmp_path / "b"))
    a, b = (spark.read.parquet(str(tmp_path / n)) for n in "ab")

    def plan_and_answer(left, right):
        got = qc.copy_mismatch(left, right, "id", ["t", "v"])
        answer = tuple(got.collect()[0])
        return final_plan(got), answer

    plan, answer = plan_and_answer(a, b)
    assert answer == (0, 0, 0) and "Join [id" not in plan and "hashpartitioning(id" not in plan
    changed = b.withColumn("t", F.when(F.col("id").isin(3, 4), "x").otherwise(F.col("t"))).withColumn("v", F.when(F.col("id") == 4, None).otherwise(F.col("v")))
    assert plan_and_answer(a, changed)[1] == (2, 2, 1)
    assert plan_and_answer(a, changed.filter("id < 4").union(spark.createDataFrame([(9999, "t", 1)], b.schema)))[1] == (1, 1, 0)
    assert plan_and_answer(a.limit(0), b)[1] == (0, 0, 0)
