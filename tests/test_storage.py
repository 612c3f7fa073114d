"""Stored tables: crash-safe switches, partitions rewritten apart, buckets, heavy keys."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from pyspark.sql import functions as F
from tests.shop import raw_shop
from tradewinds.plans import quality_suite
from tradewinds.plans.warehouse import LAYERS, Warehouse, build_all, over_layers
from tradewinds.sources import storage


def months(spark, n=60):
    month = F.concat(F.lit("1995-0"), (F.col("id") % 3 + 1).cast("string"))
    return spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"), month.alias("m"))


def rows(df):
    return Counter(map(tuple, df.select("k", "v", "m").collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_write_that_fails_halfway_leaves_the_table(spark, tmp_path, monkeypatch):
    path, old = str(tmp_path / "t"), months(spark)
    storage.overwrite_table(old, path, partition_by=["m"])
    late = F.when(F.col("v") > 100, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("long")
    with pytest.raises(Exception, match="lost"):
        storage.overwrite_table(months(spark).withColumn("v", late), path, partition_by=["m"])
    assert rows(storage.read_table(spark, path)) == rows(old)

    real = storage.json.dumps
    monkeypatch.setattr(storage.json, "dumps", lambda *a, **k: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError, match="no space"):
        storage.overwrite_table(months(spark, 9), path, partition_by=["m"])
    monkeypatch.setattr(storage.json, "dumps", real)
    assert rows(storage.read_table(spark, path)) == rows(old)
    assert rows(storage.overwrite_table(months(spark, 9), path, partition_by=["m"])) == rows(months(spark, 9))


def test_readers_keep_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    first = storage.overwrite_table(months(spark, 5), path)
    storage.overwrite_table(months(spark, 7), path)
    assert first.count() == 5
    assert storage.overwrite_table(months(spark, 8), path).count() == 8
    assert len(list((tmp_path / "t").glob("_version=*"))) == 2
    assert not list((tmp_path / "t").glob("_CURRENT-*"))


@pytest.mark.parametrize("buckets", [0, 3])
def test_changed_months_are_rewritten_alone(spark, tmp_path, buckets):
    path = str(tmp_path / "t")
    storage.overwrite_table(months(spark), path, partition_by=["m"], cluster_by=["v"], bucket_by="k", buckets=buckets)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("_version=*/m=1995-0[13]/*.parquet")}
    changed = months(spark).filter("m = '1995-02'").withColumn("v", F.col("v") + 1)
    added = spark.createDataFrame([("new", 1, "1995-07")], "k string, v long, m string")
    got = storage.overwrite_partitions(changed.union(added), path)
    assert rows(got) == rows(months(spark).filter("m <> '1995-02'").union(changed).union(added))
    assert {p: p.stat().st_mtime_ns for p in before} == before and len(before) > 0
    # a second change: what no pointer needs any more goes
    storage.overwrite_partitions(added, path)
    assert len(list((tmp_path / "t").glob("_version=*/m=1995-02"))) == 1
    assert rows(storage.read_table(spark, path)) == rows(got)


def test_partitions_need_a_table(spark, tmp_path):
    with pytest.raises(ValueError, match="no table"):
        storage.overwrite_partitions(months(spark), str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no table"):
        storage.read_table(spark, str(tmp_path / "t"))


def test_empty_tables(spark, tmp_path):
    for name, options in {"a": {}, "b": {"partition_by": ["m"]}, "c": {"partition_by": ["m"], "bucket_by": "k", "buckets": 2}}.items():
        written = storage.overwrite_table(months(spark, 0), str(tmp_path / name), heavy=["k"], **options)
        assert written.count() == 0 and written.columns == ["k", "v", "m"]


def test_buckets_are_found_again_without_the_catalog(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.overwrite_table(months(spark), path, partition_by=["m"], bucket_by="k", buckets=3)
    for table in spark.catalog.listTables():
        if table.name.startswith("stored_"):
            spark.sql(f"DROP TABLE {table.name}")
    again = storage.read_table(spark, path)
    assert rows(again) == rows(months(spark)) and "Bucketed: " in plan_of(again)


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    return build_all(raw_shop(spark), str(tmp_path_factory.mktemp("bucketed")), buckets=4)


def test_bucketed_layers_equal_lazy_plans(spark, bucketed):
    lazy = Warehouse(raw_shop(spark))
    for tables in LAYERS.values():
        for name in tables:
            assert lazy.table(name).dtypes == bucketed.table(name).dtypes, name
            assert Counter(map(tuple, lazy.table(name).collect())) == Counter(map(tuple, bucketed.table(name).collect())), name


def test_person_months_join_items_and_orders_where_they_lie(bucketed, large_sides):
    plan = plan_of(over_layers(bucketed, "stg", "dm").base_customer_monthly_purchase)
    join = plan.index("SortMergeJoin [order_id")
    below = plan[join:]
    depth = len(re.match(r"[ :|+\-*()\d]*", plan[plan.rindex("\n", 0, join) + 1 :])[0])
    inside = [line for line in below.split("\n")[1:]]
    own = []
    for line in inside:
        if len(re.match(r"[ :|+\-]*", line)[0]) < depth:
            break
        own.append(line)
    text = "\n".join(own)
    assert text.count("Bucketed: true") == 2 and "Exchange" not in text


def test_one_month_of_the_item_view_reads_one_month_of_both_facts(bucketed, large_sides):
    january = bucketed.vw_delivered_order_items.filter("year_month = '2017-01'")
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan_of(january))
    assert len(filters) == 2 and all("= 2017-01" in f for f in filters)
    assert {r["order_id"] for r in january.collect()} == {"o1"}


def test_chosen_orders_prune_months_of_the_items_at_run_time(spark, bucketed):
    chosen = bucketed.vw_delivered_order_items.filter("customer_id = 'c2'")
    assert "dynamicpruning" in plan_of(chosen)
    assert {r["order_id"] for r in chosen.collect()} == {"o6"}


def test_heavy_keys_are_kept_with_the_table_and_salted(spark, tmp_path, large_sides):
    raw = raw_shop(spark)
    item = raw["order_items"].filter("order_id = 'o6'").limit(1)
    many = item.drop("order_item_id").crossJoin(spark.range(300).select(F.col("id").cast("string").alias("order_item_id")))
    others = item.drop("order_id").crossJoin(spark.range(600).select(F.concat(F.lit("x"), F.col("id")).alias("order_id")))
    for part in (many, others):
        raw["order_items"] = raw["order_items"].unionByName(part)
    stored = build_all(raw, str(tmp_path), buckets=16)
    assert dict(stored.heavy("stg_order_items")["order_id"])["o6"] > 300
    assert stored.fact_buckets == 0  # a third of all items in one of 16 buckets
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("planning", "planning")
    view = over_layers(stored, "stg", "dm").vw_delivered_order_items
    planned = marts_plan(stored)
    assert list(jobs("planning")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "_salt" in plan_of(view) and "_salt" in plan_of(planned)
    lazy = Warehouse(raw)
    assert Counter(map(tuple, planned.collect())) == Counter(map(tuple, lazy.fact_order_items.collect()))
    assert Counter(map(tuple, view.collect())) == Counter(map(tuple, lazy.vw_delivered_order_items.collect()))


def marts_plan(stored):
    """The item fact over the stored staging tables, as yet unwritten."""
    return over_layers(stored, "stg").fact_order_items


def test_the_report_over_stored_tables_uses_what_was_kept(spark, bucketed):
    lazy, stored = quality_suite.run_qc(Warehouse(raw_shop(spark))), quality_suite.run_qc(bucketed)
    assert lazy.dtypes == stored.dtypes
    assert Counter(map(tuple, lazy.collect())) == Counter(map(tuple, stored.collect()))
    # a key check and the references read each of the eight staging tables, nothing else does
    plan = plan_of(stored).split("== Initial Plan ==")[0]
    scans = re.findall(r"FileScan parquet|Scan ExistingRDD", plan)
    assert plan.count("FileScan parquet") <= 16, scans


def test_metrics_are_those_of_the_rows_written(spark, tmp_path):
    path = str(tmp_path / "t")
    wanted = {"rows": F.count(F.lit(1)), "most": F.max("v"), "none": F.max(F.when(F.col("v") < 0, F.col("v")))}
    storage.overwrite_table(months(spark, 50), path, partition_by=["m"], metrics=wanted)
    assert storage.stored_table(spark, path).metrics == {"rows": "50", "most": "98", "none": None}
    storage.overwrite_partitions(months(spark, 3), path)
    assert storage.stored_table(spark, path).metrics == {}
