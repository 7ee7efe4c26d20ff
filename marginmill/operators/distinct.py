"""Distinct counts over any span of months and choice of campaigns, from sketches that are stored once and merged.

A distinct count is not additive: a customer of two months counts once. A sketch of each month and campaign has a fixed
size (some KB) and merges without loss, so a report over any span reads as many rows as there are months and campaigns and no
sold item. Estimates lie within `error_bound` of the exact count; `exact_counts` is the reference.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import month_start
from .joins import order_key, part_of, with_campaign_id
from .relational import as_list, with_keys

#: Logarithm of the number of registers of a sketch.
LG_K = 14
#: What is counted in sales by month and campaign.
COUNTED = {"orders": "order_id", "products": "product_id", "customers": "customer_id"}
KEYS = ["month_start", "campaign_id"]


def error_bound(exact: Column, lg_k: int = LG_K) -> Column:
    """Four standard errors of a merged sketch; small counts may still be off by one."""
    return F.greatest(F.lit(1.0), exact * (4 * 1.04 / 2 ** (lg_k / 2)))


def sales_keys(sales: DataFrame, orders: DataFrame, mapping: DataFrame) -> DataFrame:
    """Month, campaign, order, product and customer of every item whose order has a month and a campaign. Order attributes
    are joined among orders first, so the items meet them once."""
    placed = orders.select(
        "order_id", *part_of(orders), "customer_id", month_start(F.col("order_purchase_timestamp")).alias("month_start")
    )
    by_order = with_keys(with_campaign_id(placed, mapping), KEYS)
    key = order_key(sales, by_order)
    return sales.select(*key, "product_id").join(by_order, key).select(*KEYS, *COUNTED.values())


def sketches(df: DataFrame, keys, counted: dict[str, str], lg_k: int = LG_K) -> DataFrame:
    """A sketch of the distinct values (not NULL) of each column of `counted`, for each group; rows with a NULL key belong to
    none. Keys and values are ints, texts or bytes."""
    measures = [F.hll_sketch_agg(column, F.lit(lg_k)).alias(name) for name, column in counted.items()]
    return with_keys(df, keys).groupBy(*as_list(keys)).agg(*measures)


def estimates(stored: DataFrame, keys, names) -> DataFrame:
    """Stored sketches merged on fewer keys (none gives one row), each as its estimated count."""
    return stored.groupBy(*as_list(keys)).agg(*[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in names])


def over_span(df: DataFrame, low: str, high: str) -> DataFrame:
    """Rows of the months low to high ('yyyy-MM'), of items or of sketches alike."""
    first, last = (F.lit(f"{month}-01").cast("date") for month in (low, high))
    return df.filter(F.col("month_start").between(first, last))


def exact_counts(df: DataFrame, keys, counted: dict[str, str]) -> DataFrame:
    return with_keys(df, keys).groupBy(*as_list(keys)).agg(*[F.count_distinct(F.col(c)).alias(n) for n, c in counted.items()])


def reach(stored: DataFrame, low: str, high: str) -> DataFrame:
    """campaign_id and the estimated distinct orders, products and customers of a span."""
    return estimates(over_span(stored, low, high), "campaign_id", COUNTED)


def reach_checked(keys: DataFrame, stored: DataFrame, low: str, high: str) -> DataFrame:
    """The exact counts of a span, and whether each estimate lies within its bound."""
    exact = exact_counts(over_span(keys, low, high), "campaign_id", COUNTED)
    found = reach(stored, low, high).select("campaign_id", *[F.col(n).alias(f"_{n}") for n in COUNTED])
    close = [(F.abs(F.col(f"_{n}") - F.col(n)) <= error_bound(F.col(n))).alias(f"{n}_close") for n in COUNTED]
    return exact.join(found, "campaign_id", "left").select("campaign_id", *COUNTED, *close)
