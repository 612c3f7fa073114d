"""Registered queries against their reference SQL on the small driver tables.

A cross-section runs by default; TRADEWINDS_ALL_QUERIES=1 runs every query.
"""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from __spark_entry__ import entry
from oracles import oracle_queries as oracle_sql
from tests.compare import differences, duck
from tradewinds.registry import all_queries as queries

FOLDER = os.environ.get("TRADEWINDS_TEST_FOLDER", "/root/testdata/sf0.001")
CORE = """raw_order_reviews overwrite_table schema_report stg_orders stg_products stg_geolocation mode_by_key_collated
dim_date fact_order_items kpi_monthly_cancellation cohort_monthly_core cohort_pivot_aov dense_customer_month
revenue_trend_quarter orders_vs_aov_decomposition cancellation_by_category kpi_operations_summary
flag_snapshot referential_summary orphan_drilldown cross_table_event_order grand_total_reconcile""".split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_reference_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", list(queries()) if os.environ.get("TRADEWINDS_ALL_QUERIES") else CORE)
def test_query(spark, con, name):
    _, found = differences(queries()[name](spark, FOLDER), con, oracle_sql()[name])
    assert not found


WRITING = {name for name in queries() if name.startswith("raw_")} | {"overwrite_table", "overwrite_partitions", "fact_orders_of_month"}


def test_building_a_plan_starts_no_job(spark, large_sides):
    """Also where no looked-up side is small; queries that write tables are left out."""
    context = spark.sparkContext
    context.setJobGroup("plans", "plans only")
    try:
        built = {name: build(spark, FOLDER) for name, build in queries().items() if name not in WRITING}
        assert len(built) > 150 and list(context.statusTracker().getJobIdsForGroup("plans")) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


LOOKUPS = """fact_orders fact_order_items vw_delivered_order_items vw_customer_first_purchase_month
base_customer_monthly_purchase kpi_monthly_core stg_products kpi_sales_summary revenue_by_category
cancellation_by_category multi_mapped_values cohort_order_history orphan_count view_vs_source_person_month""".split()


@pytest.mark.parametrize("name", LOOKUPS)
def test_query_with_large_sides(spark, con, large_sides, name):
    _, found = differences(queries()[name](spark, FOLDER), con, oracle_sql()[name])
    assert not found


def test_flagship(spark):
    assert entry(spark).count() > 0
