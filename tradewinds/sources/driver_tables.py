"""The nine raw tables derived from the TPC-H-like driver tables.

Defects are planted on purpose so that the cleaning and quality operators have work to do:
case noise, carriage returns, blanks, unparseable times, zero values, missing payments, a
coverage gap, out-of-range latitudes, several states per zip, reviews before the purchase, reviews with commas, quotes
and line breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CR = "\r"
STATE_CODES = "SPRJMGPRRS"


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _every(column: str, n: int, remainder: int = 0) -> Column:
    return F.col(column) % n == remainder


def _zip(nation: str) -> Column:
    return F.lpad(_text(nation), 5, "0")


def _state(nation: str, codes: str = STATE_CODES) -> Column:
    return F.substring(F.lit(codes), (1 + 2 * (F.col(nation) % 5)).cast("int"), F.lit(2))


def _shifted(ts: str, interval: str) -> Column:
    return (F.col(ts) + F.expr(f"interval {interval}")).cast("string")


def orders(t) -> DataFrame:
    shipped = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", " Delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .when(_every("o_orderkey", 3), "canceled")
        .when(_every("o_orderkey", 3, 1), "unavailable")
        .otherwise("processing")
    )
    has_arrival = (F.col("o_orderstatus") == "F") | _every("o_orderkey", 50, 1)
    return t("orders").join(shipped, "o_orderkey", "left").select(
        _text("o_orderkey").alias("order_id"),
        _text("o_custkey").alias("customer_id"),
        F.concat(status, F.when(_every("o_orderkey", 10), CR).otherwise("")).alias("order_status"),
        F.when(_every("o_orderkey", 997, 5), "n/a").otherwise(_text("o_orderdate")).alias("order_purchase_timestamp"),
        F.when(_every("o_orderkey", 11), "").otherwise(_shifted("o_orderdate", "26 hours")).alias("order_approved_at"),
        F.coalesce(_text("first_ship"), F.lit("")).alias("order_delivered_carrier_date"),
        F.when(has_arrival, F.coalesce(_text("last_ship"), F.lit("")))
        .otherwise("")
        .alias("order_delivered_customer_date"),
        _shifted("o_orderdate", "30 days").alias("order_estimated_delivery_date"),
    )


def order_items(t) -> DataFrame:
    """The line number is the item id as it stands, repeated pairs included: numbering the lines
    of an order anew would sort a heavy order in one task, and the repeats are findings for the key checks."""
    return t("lineitem").select(
        _text("l_orderkey").alias("order_id"),
        _text("l_linenumber").alias("order_item_id"),
        _text("l_partkey").alias("product_id"),
        _text("l_suppkey").alias("seller_id"),
        _text("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
        F.col("l_quantity").cast("decimal(10,2)").alias("freight_value"),
    )


def order_payments(t) -> DataFrame:
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Credit_Card ")
        .when(F.col("o_orderpriority") == "2-HIGH", "boleto")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "voucher")
        .when(F.col("o_orderpriority") == "5-LOW", "debit_card")
        .otherwise("not_defined")
    )
    parts = F.when(_every("o_orderkey", 20), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t("orders").filter(~_every("o_orderkey", 1000, 7)).select(
        _text("o_orderkey").alias("order_id"),
        F.explode(parts).alias("payment_sequential"),
        kind.alias("payment_type"),
        (F.col("o_orderkey") % 25).cast("int").alias("payment_installments"),
        F.when(_every("o_orderkey", 500, 3), F.lit(0).cast("decimal(10,2)"))
        .otherwise(F.col("o_totalprice").cast("decimal(10,2)"))
        .alias("payment_value"),
    )


def order_reviews(t) -> DataFrame:
    written = F.when(_every("o_orderkey", 40), F.col("o_orderdate") - F.expr("interval 1 day")).otherwise(
        F.col("o_orderdate") + F.expr("interval 12 days")
    )
    return t("orders").filter(~_every("o_orderkey", 7)).select(
        F.concat(F.lit("r"), _text("o_orderkey")).alias("review_id"),
        _text("o_orderkey").alias("order_id"),
        (F.col("o_orderkey") % 5 + 1).cast("int").alias("review_score"),
        F.when(_every("o_orderkey", 3), " title").otherwise(" ").alias("review_comment_title"),
        F.when(_every("o_orderkey", 4), F.concat("o_orderpriority", F.lit(', "quick"\nand "", well,\n\npacked' + CR)))
        .when(_every("o_orderkey", 2), F.concat("o_orderpriority", F.lit(CR)))
        .otherwise("")
        .alias("review_comment_message"),
        _text(written).alias("review_creation_date"),
        _shifted("o_orderdate", "15 days").alias("review_answer_timestamp"),
    )


def customers(t) -> DataFrame:
    return t("customer").select(
        _text("c_custkey").alias("customer_id"),
        F.concat(F.lit("u"), _text(F.col("c_custkey") - F.col("c_custkey") % 2)).alias("customer_unique_id"),
        _zip("c_nationkey").alias("customer_zip_code_prefix"),
        F.concat(F.lit(" "), F.col("c_mktsegment")).alias("customer_city"),
        F.concat(_state("c_nationkey", STATE_CODES.lower()), F.lit(CR)).alias("customer_state"),
    )


def products(t) -> DataFrame:
    return t("part").select(
        _text("p_partkey").alias("product_id"),
        F.when(_every("p_partkey", 50), "").otherwise(F.concat("p_type", F.lit(CR))).alias("product_category_name"),
        F.length("p_name").alias("product_name_length"),
        (F.col("p_size") * 10).cast("int").alias("product_description_length"),
        (F.col("p_partkey") % 6 + 1).cast("int").alias("product_photos_qty"),
        F.when(_every("p_partkey", 100, 1), 0).otherwise(F.col("p_size") * 100).cast("int").alias("product_weight_g"),
        F.when(~_every("p_partkey", 90, 2), F.col("p_size")).cast("int").alias("product_length_cm"),
        (F.col("p_size") % 10 + 2).cast("int").alias("product_height_cm"),
        (F.col("p_size") % 7 + 6).cast("int").alias("product_width_cm"),
    )


def sellers(t) -> DataFrame:
    city = F.when(_every("s_suppkey", 9, 4), " ").otherwise(F.concat(F.lit("City "), _text("s_nationkey")))
    return t("supplier").select(
        _text("s_suppkey").alias("seller_id"),
        _zip("s_nationkey").alias("seller_zip_code_prefix"),
        city.alias("seller_city"),
        _state("s_nationkey").alias("seller_state"),
    )


def geolocation(t) -> DataFrame:
    city = F.when(_every("c_custkey", 2), F.upper("c_mktsegment")).otherwise(
        F.concat(F.lower("c_mktsegment"), F.lit(CR))
    )
    return t("customer").filter("c_nationkey <> 24").select(
        _zip("c_nationkey").alias("geolocation_zip_code_prefix"),
        (F.col("c_custkey") % 45 - 37).cast("decimal(10,6)").alias("geolocation_lat"),
        (-30 - F.col("c_custkey") % 5).cast("decimal(10,6)").alias("geolocation_lng"),
        city.alias("geolocation_city"),
        F.when(_every("c_custkey", 30), "SP").otherwise(_state("c_nationkey")).alias("geolocation_state"),
    )


def category_translation(t) -> DataFrame:
    return t("part").filter("p_type <> 'ECONOMY'").select("p_type").distinct().select(
        F.col("p_type").alias("product_category_name"),
        F.concat(F.lit("en_"), F.lower("p_type")).alias("product_category_name_english"),
    )


ADAPTERS = {
    "orders": orders,
    "order_items": order_items,
    "order_payments": order_payments,
    "order_reviews": order_reviews,
    "customers": customers,
    "products": products,
    "sellers": sellers,
    "geolocation": geolocation,
    "category_translation": category_translation,
}


# Fixed column types of the driver tables: no job has to look them up in file footers.
DRIVER_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


class DriverTables:
    """Raw marketplace tables over one folder; each file is opened once."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self._spark.read.schema(DRIVER_SCHEMAS[name])
            self._tables[name] = reader.parquet(f"{self._folder}/{name}.parquet")
        return self._tables[name]

    def raw(self, name: str) -> DataFrame:
        return ADAPTERS[name](self.table)
