"""Joins of the star schema.

No join carries a broadcast hint: the optimizer broadcasts a side whose size it knows (files, inline relations)
or has measured (finished shuffle stages) to be under the threshold, and sort-merge joins with skew splitting
otherwise. Order attributes are joined among orders first, so the fact meets its orders once.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SEGMENT_NAMES
from ..functions.columns import month_start, recode
from .features import sales_features
from .relational import fill_unknown, month_range, spread_join


#: Columns of a laid-out fact (`plans.layout`): which part of a heavy order a row lies in, and the first day of the order's month.
LAYOUT = ORDER_PART, ORDER_MONTH = "_order_part", "_order_month"


def order_key(sales: DataFrame, by_order: DataFrame) -> list[str]:
    """The columns that join sold items to rows by order. Laid-out tables are joined on the part as well: a heavy order has a
    row for each of its parts there."""
    return ["order_id", *[c for c in (ORDER_PART,) if c in sales.columns and c in by_order.columns]]


def part_of(by_order: DataFrame) -> list[str]:
    """What a projection of rows by order has to keep besides the order."""
    return [c for c in (ORDER_PART,) if c in by_order.columns]


def translate_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """product_id, category; NULL where the category has no translation."""
    return products.join(translation, "product_category_name", "left").select(
        "product_id", F.col("product_category_name_english").alias("category")
    )


def with_category(df: DataFrame, products_tr: DataFrame, unknown: str = "drop") -> DataFrame:
    """Category of each product; unknown='keep' turns a missing one into a category of its own."""
    joined = df.join(products_tr, "product_id", "left")
    return fill_unknown(joined, "category") if unknown == "keep" else joined


def with_campaign_id(sales: DataFrame, mapping: DataFrame) -> DataFrame:
    key = order_key(sales, mapping)
    return sales.join(mapping.select(*key, "campaign_id"), key, "left")


def with_campaign(df: DataFrame, campaigns: DataFrame, cols=("campaign_name", "channel", "discount_pct", "budget")):
    return df.join(campaigns.select("campaign_id", *cols), "campaign_id", "left")


def with_orders(sales: DataFrame, orders: DataFrame, how: str = "inner", cols=("customer_id",)) -> DataFrame:
    key = order_key(sales, orders)
    return sales.join(orders.select(*key, *cols), key, how)


def in_months(sales: DataFrame, orders: DataFrame, low: str, high: str) -> DataFrame:
    """Items of the orders of [low, high], given as 'yyyy-MM', with `month_start`. A laid-out fact has the month on its rows
    and is read in the partitions of these months alone, without a join; otherwise only orders of these months are read on."""
    if ORDER_MONTH in sales.columns:
        first, last = (F.lit(f"{month}-01").cast("date") for month in (low, high))
        return sales.filter(F.col(ORDER_MONTH).between(first, last)).withColumnRenamed(ORDER_MONTH, "month_start")
    kept = month_range(orders, "order_purchase_timestamp", low, high).select(
        "order_id", *part_of(orders), month_start(F.col("order_purchase_timestamp")).alias("month_start")
    )
    return sales.join(kept, order_key(sales, kept))


def with_segment(df: DataFrame, segments: DataFrame, how: str = "inner", plain_names: bool = False) -> DataFrame:
    """`df` has an order per row or finer; a customer may have any number of them."""
    by_customer = segments.select("customer_id", "customer_segment")
    joined = spread_join(df, by_customer, "customer_id", how)
    if plain_names:
        joined = joined.withColumn("customer_segment", recode(F.col("customer_segment"), SEGMENT_NAMES))
    return joined


def order_segments(orders: DataFrame, segments: DataFrame, how: str = "inner", plain_names: bool = False) -> DataFrame:
    """order_id, customer_segment: resolved on orders, which are fewer than sold items."""
    customers_of = orders.select("order_id", *part_of(orders), "customer_id")
    return with_segment(customers_of, segments, how, plain_names).select("order_id", *part_of(orders), "customer_segment")


def sales_wide(
    items: DataFrame,
    costs: DataFrame | None,
    orders: DataFrame,
    segments: DataFrame,
    products_tr: DataFrame,
    mapping: DataFrame,
    campaigns: DataFrame,
    *,
    unknown: str = "keep",
    plain_names: bool = True,
) -> DataFrame:
    """Item-grain star join. Cost and category are joined to each other first, and so are segment, campaign and
    discount of the orders: the items are joined once by product and once by order. Without costs the items are the
    stored sales fact. A hot product is spread over tasks, and so is a hot order, which lies spread in a laid-out fact."""
    by_order = with_segment(orders, segments, "inner", plain_names)
    by_order = with_campaign(with_campaign_id(by_order, mapping), campaigns, ("campaign_name", "discount_pct"))
    if costs is None:
        sales = spread_join(items, products_tr, "product_id")
    else:
        sales = sales_features(items, costs.join(products_tr, "product_id", "full"))
    if unknown == "keep":
        sales = fill_unknown(sales, "category")
    key = order_key(sales, by_order)
    if len(key) > 1:
        return sales.join(by_order, key).drop(*LAYOUT)
    return spread_join(sales, by_order, "order_id", "inner", counted=items)
