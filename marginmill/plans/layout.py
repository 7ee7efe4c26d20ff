"""The sales fact laid out for joins and spans: catalog tables bucketed on the order, the fact in partitions by month.

A join of the fact with its orders or its campaigns then shuffles neither side, and a report over some months lists
the files of those months only. Rows of heavy orders (`relational.heavy_keys`) are dealt by a hash of the whole row into as many parts as there are
buckets: the part is a second bucket column, and the order's row is repeated for each part. Equal rows lie in one part.
"""

import hashlib
import time
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import month_start
from ..operators.joins import ORDER_MONTH, ORDER_PART
from ..operators.relational import heavy_keys
from ..sources import tables
from .shop import Shop

KEY = ["order_id", ORDER_PART]
FACT, ORDERS, MAPPING = "sales_features", "orders", "campaign_sales_mapping"


def _databases(directory: str) -> str:
    """The names of all databases written for a directory begin with this."""
    return f"layout_{hashlib.sha256(directory.rstrip('/').encode()).hexdigest()[:12]}_"


def _save(df: DataFrame, name: str, buckets: int, *partitions: str) -> DataFrame:
    """Rows are brought to their buckets by one shuffle, so a bucket is one file (one for each month of the fact)."""
    writer = df.write.mode("errorifexists").format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def write_layout(spark: SparkSession, shop: Shop, directory: str, buckets: int) -> Shop:
    """Write orders, mapping and fact into a database of their own, then point `directory` to it: readers see the tables of
    the last run that ended, and a lost run changes nothing. The database before stays for readers that have begun; older
    ones, and those of lost runs, are dropped. One run at a time may write a directory. Choose `buckets` so that a bucket of one
    month has some 100 MB.

    `order_id` is the key of orders and mapping. Items without an order, or whose order has no time, lie in a partition without
    a month."""
    directory = directory.rstrip("/")
    # One list for all three tables: fewer than 1,000 keys by arithmetic.
    heavy = heavy_keys(shop.items, "order_id").first()["keys"]
    is_heavy = F.col("order_id").isin(heavy) if heavy else F.lit(False)

    def parts(columns) -> Column:
        spread = F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
        return F.when(F.col("order_id").isNull() | is_heavy, spread).otherwise(0)

    copies = F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0))))
    database = f"{_databases(directory)}{time.time_ns()}"
    spark.sql(f"CREATE DATABASE {database}")
    by_order = {ORDERS: shop.orders, MAPPING: shop.mapping}
    laid = {
        name: _save(df.withColumn(ORDER_PART, copies).repartition(buckets, *KEY), f"{database}.{name}", buckets)
        for name, df in by_order.items()
    }
    months = laid[ORDERS].select(*KEY, month_start(F.col("order_purchase_timestamp")).alias(ORDER_MONTH))
    sales = shop.sales.withColumn(ORDER_PART, parts(shop.sales.columns)).repartition(buckets, *KEY)
    _save(sales.join(months, KEY, "left").select(*sales.columns, ORDER_MONTH), f"{database}.{FACT}", buckets, ORDER_MONTH)
    before = _current(spark, directory)
    tables.point_to(spark, directory, database)
    for row in spark.sql(f"SHOW DATABASES LIKE '{_databases(directory)}*'").collect():
        if row[0] not in (database, before):
            spark.sql(f"DROP DATABASE {row[0]} CASCADE")
    return with_layout(spark, shop, directory)


def _current(spark: SparkSession, directory: str) -> str | None:
    found = tables.current_version(spark, directory)
    return None if found == directory else found.rsplit("/", 1)[-1]


def with_layout(spark: SparkSession, shop: Shop, directory: str) -> Shop:
    """The same shop with its fact read from the tables that `write_layout` has written."""
    database = _current(spark, directory.rstrip("/"))
    if database is None:
        raise ValueError(f"no layout was written to {directory}")
    fact, orders, mapping = (spark.table(f"{database}.{name}") for name in (FACT, ORDERS, MAPPING))
    return replace(shop, stored_sales=fact, laid_orders=orders, laid_mapping=mapping)
