"""All tables of the four layers by name, each built on demand from the ones below it.

Without ``storage`` every table is a lazy plan down to the raw tables. With it a table is
written once (Parquet) and everything above reads the written table, which cuts lineage,
gives the planner true sizes and shares work between reports.

Stored tables with an order key are bucketed by it where they are large, so that they join without a shuffle; keys that
hold a large share of a table are found when it is written, and the plans above salt them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradewinds.operators.joins import BYTES_IN_MEMORY_PER_FILE_BYTE, HEAVY_SHARE, UNKNOWN_BYTES, input_bytes
from tradewinds.plans import analysis, counters, marts, staging
from tradewinds.sources.schemas import TABLE_SCHEMAS
from tradewinds.sources.storage import overwrite_table, read_table, stored_table

# what a bucket takes in memory over all months, where no more than MOST_BUCKETS are needed for that: a bucket has a
# file in every month
BUCKET_BYTES, MOST_BUCKETS = 2 << 30, 1 << 13
# beside the layers: what later changes of single months are merged into
PERSON_MONTHS, MONTH_BOUNDS = "state/person_months", "state/month_bounds"
# stored by order where there are buckets
BY_ORDER = ("stg_orders", "stg_order_items", "stg_order_payments", "stg_order_reviews", "fact_orders", "fact_order_items")
# columns of stored tables whose heavy keys are looked for
LOOKED_UP = {"stg_orders": ("customer_id",), "stg_order_items": ("order_id", "seller_id"), "fact_order_items": ("order_id",)}

LAYERS: dict[str, tuple[str, ...]] = {
    "stg": (
        "stg_orders",
        "stg_customers",
        "stg_order_items",
        "stg_products",
        "stg_sellers",
        "stg_order_payments",
        "stg_order_reviews",
        "stg_geolocation",
    ),
    "dm": (
        "dim_date",
        "dim_geolocation",
        "dim_customer",
        "dim_product",
        "dim_seller",
        "fact_order_items",
        "fact_orders",
    ),
    "am": (
        "base_customer_monthly_purchase",
        "kpi_monthly_core",
        "kpi_monthly_cancellation",
        "cohort_monthly_core",
    ),
}


class Warehouse:
    """Tables as attributes: ``Warehouse(raw).kpi_monthly_core``.

    ``buckets``: of the tables by order; None for a number that follows the size of the items, 0 where they are small.
    """

    def __init__(
        self, raw: Mapping[str, DataFrame] | Callable[[str], DataFrame], storage: str | None = None, buckets: int | None = None
    ):
        self._raw = raw if callable(raw) else raw.__getitem__
        self._storage = storage
        self._raw_cache: dict[str, DataFrame] = {}
        self._asked_buckets = buckets

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw_cache:
            self._raw_cache[name] = self._raw(name)
        return self._raw_cache[name]

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def _buckets(self) -> int:
        if self._storage is None:
            return 0
        if self._asked_buckets is not None:
            return self._asked_buckets
        size = input_bytes(self.raw("order_items")) or 0
        if size >= UNKNOWN_BYTES or size * BYTES_IN_MEMORY_PER_FILE_BYTE < 2 * BUCKET_BYTES:
            return 0
        return min(MOST_BUCKETS, 1 << (size * BYTES_IN_MEMORY_PER_FILE_BYTE // BUCKET_BYTES).bit_length())

    def path(self, name: str) -> str:
        layer = next(layer for layer, names in LAYERS.items() if name in names)
        return f"{self._storage}/{layer}/{name}"

    def heavy(self, name: str) -> dict[str, list[tuple[object, int]]]:
        """The heavy keys kept beside a stored table, by column; none without storage."""
        if self._storage is None:
            return {}
        table = stored_table(self.table(name).sparkSession, self.path(name))
        return {key: table.heavy_keys(key) for key in table.heavy} if table else {}

    def metrics(self, name: str) -> dict[str, str | None]:
        """The metrics kept beside a stored table; none without storage."""
        if self._storage is None:
            return {}
        table = stored_table(self.table(name).sparkSession, self.path(name))
        return dict(table.metrics) if table else {}

    @cached_property
    def staged_buckets(self) -> int:
        """Buckets of the staging tables by order."""
        return self._buckets

    @cached_property
    def fact_buckets(self) -> int:
        """Buckets of the facts: none where one order would fill more than two buckets' share."""
        widest = max((salts for _, salts in self.heavy("stg_order_items").get("order_id", [])), default=0)
        return 0 if widest * HEAVY_SHARE * self._buckets > 2 else self._buckets

    def keep(self, name: str, df: DataFrame, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = ()) -> DataFrame:
        if self._storage is None:
            return df
        schema = T.StructType(TABLE_SCHEMAS[name].fields + [df.schema[c] for c in partition_by])
        buckets = (self.fact_buckets if name.startswith("fact_") else self._buckets) if name in BY_ORDER else 0
        return overwrite_table(
            df,
            self.path(name),
            schema,
            partition_by,
            cluster_by,
            "order_id",
            buckets,
            LOOKED_UP.get(name, ()),
            counters.metrics(name, schema.names),
        )

    # staging

    @cached_property
    def stg_orders(self) -> DataFrame:
        return self.keep("stg_orders", staging.stg_orders(self.raw("orders")))

    @cached_property
    def stg_customers(self) -> DataFrame:
        return self.keep("stg_customers", staging.stg_customers(self.raw("customers")))

    @cached_property
    def stg_order_items(self) -> DataFrame:
        return self.keep("stg_order_items", staging.stg_order_items(self.raw("order_items")))

    @cached_property
    def stg_products(self) -> DataFrame:
        products = staging.stg_products(self.raw("products"), self.raw("category_translation"))
        return self.keep("stg_products", products)

    @cached_property
    def stg_sellers(self) -> DataFrame:
        return self.keep("stg_sellers", staging.stg_sellers(self.raw("sellers")))

    @cached_property
    def stg_order_payments(self) -> DataFrame:
        return self.keep("stg_order_payments", staging.stg_order_payments(self.raw("order_payments")))

    @cached_property
    def stg_order_reviews(self) -> DataFrame:
        return self.keep("stg_order_reviews", staging.stg_order_reviews(self.raw("order_reviews")))

    @cached_property
    def stg_geolocation(self) -> DataFrame:
        return self.keep("stg_geolocation", staging.stg_geolocation(self.raw("geolocation")))

    # star schema

    @cached_property
    def dim_date(self) -> DataFrame:
        return self.keep("dim_date", marts.dim_date(self.stg_orders))

    @cached_property
    def dim_geolocation(self) -> DataFrame:
        return self.keep("dim_geolocation", marts.dim_geolocation(self.stg_geolocation))

    @cached_property
    def dim_customer(self) -> DataFrame:
        return self.keep("dim_customer", marts.dim_customer(self.stg_customers))

    @cached_property
    def dim_product(self) -> DataFrame:
        return self.keep("dim_product", marts.dim_product(self.stg_products))

    @cached_property
    def dim_seller(self) -> DataFrame:
        return self.keep("dim_seller", marts.dim_seller(self.stg_sellers))

    @cached_property
    def fact_order_items_by_month(self) -> DataFrame:
        heavy = {**self.heavy("stg_orders"), **self.heavy("stg_order_items")}
        items = marts.fact_order_items(self.stg_order_items, self.stg_orders, self.stg_customers, self.stg_sellers, heavy)
        return self._by_month("fact_order_items", items)

    @cached_property
    def fact_orders_by_month(self) -> DataFrame:
        return self._by_month("fact_orders", marts.fact_orders(self.stg_orders, self.stg_customers, self.heavy("stg_orders")))

    def _by_month(self, name: str, fact: DataFrame) -> DataFrame:
        """The fact with the month label of its purchase, by which its files are kept apart."""
        dated = marts.with_month(fact, "order_purchase_date_key")
        return self.keep(name, dated, ["year_month"], ["order_purchase_date_key"])

    @cached_property
    def fact_order_items(self) -> DataFrame:
        return self.fact_order_items_by_month.drop("year_month")

    @cached_property
    def fact_order_items_by_order(self) -> DataFrame:
        """The same rows for plans that group them by order; an item fact that is not stored is dealt by order for them."""
        if self._storage is not None or self.staged_buckets:
            return self.fact_order_items
        tables = self.stg_order_items, self.stg_orders, self.stg_customers, self.stg_sellers
        heavy = {**self.heavy("stg_orders"), **self.heavy("stg_order_items")}
        return marts.fact_order_items(*tables, heavy, by_order=True)

    @cached_property
    def fact_orders(self) -> DataFrame:
        return self.fact_orders_by_month.drop("year_month")

    # views over the star schema, never stored

    @cached_property
    def vw_delivered_orders(self) -> DataFrame:
        return marts.vw_delivered_orders(self.fact_orders_by_month)

    @cached_property
    def vw_delivered_order_items(self) -> DataFrame:
        heavy = self.heavy("fact_order_items").get("order_id", ())
        return marts.vw_delivered_order_items(self.fact_order_items_by_month, self.vw_delivered_orders, heavy)

    @cached_property
    def vw_customer_first_purchase_month(self) -> DataFrame:
        return marts.vw_customer_first_purchase_month(self.vw_delivered_orders, self.dim_customer)

    # analysis

    @cached_property
    def person_months(self) -> DataFrame:
        """Totals of persons by month, stored by month."""
        # the item fact, stored or not: repeated order or customer rows repeat items there
        totals = analysis.person_months(self.vw_delivered_orders, self.fact_order_items, self.dim_customer, self.fact_buckets > 0)
        if self._storage is None:
            return totals
        return overwrite_table(totals, f"{self._storage}/{PERSON_MONTHS}", partition_by=["year_month"])

    @cached_property
    def month_bounds(self) -> DataFrame:
        """The first and last date of each month's orders."""
        bounds = marts.month_bounds(self.fact_orders_by_month)
        return bounds if self._storage is None else overwrite_table(bounds, f"{self._storage}/{MONTH_BOUNDS}")

    @cached_property
    def base_customer_monthly_purchase(self) -> DataFrame:
        return self.keep("base_customer_monthly_purchase", analysis.with_cohorts(self.person_months))

    @cached_property
    def kpi_monthly_core(self) -> DataFrame:
        core = analysis.kpi_monthly_core(self.dim_date, self.base_customer_monthly_purchase)
        return self.keep("kpi_monthly_core", core)

    @cached_property
    def kpi_monthly_cancellation(self) -> DataFrame:
        kpi = analysis.kpi_monthly_cancellation(self.fact_orders, self.dim_date)
        return self.keep("kpi_monthly_cancellation", kpi)

    @cached_property
    def cohort_monthly_core(self) -> DataFrame:
        core = analysis.cohort_monthly_core(self.dim_date, self.base_customer_monthly_purchase)
        return self.keep("cohort_monthly_core", core)


def over_layers(stored: Warehouse, *layers: str) -> Warehouse:
    """A lazy warehouse whose tables of the given layers are the stored ones."""
    lazy = Warehouse(stored.raw)
    for layer in layers:
        for name in LAYERS[layer]:
            lazy.__dict__[name] = stored.table(name)
    if "dm" in layers:
        for name in ("fact_orders_by_month", "fact_order_items_by_month"):
            lazy.__dict__[name] = stored.table(name)
        lazy.__dict__["fact_order_items_by_order"] = stored.fact_order_items
        lazy.__dict__["fact_buckets"] = stored.fact_buckets
    lazy.__dict__["heavy"] = stored.heavy
    if "stg" in layers:
        lazy.__dict__["metrics"] = stored.metrics
        lazy.__dict__["staged_buckets"] = stored.staged_buckets
    return lazy


def open_all(raw: Mapping[str, DataFrame] | Callable[[str], DataFrame], storage: str) -> Warehouse:
    """The warehouse whose tables ``build_all`` has written below ``storage``; writes nothing."""
    warehouse = Warehouse(raw, storage)
    spark, found = warehouse.raw("orders").sparkSession, warehouse.__dict__
    for name in (n for names in LAYERS.values() for n in names):
        found[name] = read_table(spark, warehouse.path(name))
        if name.startswith("fact_"):
            found[f"{name}_by_month"], found[name] = found[name], found[name].drop("year_month")
    found["fact_buckets"] = stored_table(spark, warehouse.path("fact_orders")).buckets
    found["person_months"] = read_table(spark, f"{storage}/{PERSON_MONTHS}")
    found["month_bounds"] = read_table(spark, f"{storage}/{MONTH_BOUNDS}")
    return warehouse


def build_all(
    raw: Mapping[str, DataFrame] | Callable[[str], DataFrame], storage: str, buckets: int | None = None
) -> Warehouse:
    """Write every table of every layer below ``storage``, bottom up, and return the warehouse."""
    warehouse = Warehouse(raw, storage, buckets)
    for tables in LAYERS.values():
        for name in tables:
            warehouse.table(name)
    warehouse.table("month_bounds")
    return warehouse
