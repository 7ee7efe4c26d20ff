"""Reports by customer segment. The segment of an order is resolved before the items are joined."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SEGMENT_NAMES
from ..functions.columns import recode, round_even
from .joins import order_key, with_category
from .relational import arg_max, filter_opt, top_k_per_group
from .totals import avg_margin_pct, items_count, key_totals, order_totals, orders_count, product_totals, profit, revenue, roll_up

# Treatment of each plain-language segment.
TREATMENTS = {
    SEGMENT_NAMES["Premium"]: "no discounts: offer fast delivery or gift wrapping",
    SEGMENT_NAMES["High Value"]: "spend-and-save deals for the next visit",
    SEGMENT_NAMES["Regular"]: "weekend sales of 10% to 15%",
    SEGMENT_NAMES["Occasional"]: "large clearance discounts of about 20%",
}


def segment_product_totals(
    sales: DataFrame, order_segments: DataFrame, costs: DataFrame | None = None, how: str = "inner"
) -> DataFrame:
    """Totals by segment and product: the only fact-sized join of this family."""
    return product_totals(sales.join(order_segments, order_key(sales, order_segments), how), costs, ["customer_segment"])


def segment_totals(
    sales: DataFrame, order_segments: DataFrame, costs: DataFrame | None = None, how: str = "inner"
) -> DataFrame:
    return key_totals(sales.join(order_segments, order_key(sales, order_segments), how), costs, ["customer_segment"])


def segment_profitability(totals: DataFrame) -> DataFrame:
    return totals.select(
        "customer_segment",
        round_even(revenue()).alias("revenue"),
        round_even(profit()).alias("gross_profit"),
        round_even(avg_margin_pct()).alias("avg_margin_pct"),
    )


def best_segment(profitability: DataFrame) -> DataFrame:
    return arg_max(profitability, "customer_segment", "gross_profit")


def segment_order_totals(sales: DataFrame, order_segments: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """Totals by segment with distinct orders."""
    return order_totals(sales.join(order_segments, order_key(sales, order_segments)), costs, ["customer_segment"])


def segment_summary(totals: DataFrame) -> DataFrame:
    """Revenue, profit, mean margin, distinct orders and average order value per segment, from totals with orders."""
    sums = totals.select(
        F.col("customer_segment").alias("segment"),
        revenue().alias("revenue"),
        profit().alias("profit"),
        avg_margin_pct().alias("avg_margin_pct"),
        orders_count().alias("total_orders"),
    )
    return sums.withColumn("aov", F.try_divide("revenue", "total_orders"))


def segment_top_categories(
    by_product: DataFrame, products_tr: DataFrame, k: int = 5, segment: str | None = None
) -> DataFrame:
    named = with_category(filter_opt(by_product, "customer_segment", segment), products_tr, "keep")
    rows = roll_up(named, ["customer_segment", "category"]).select(
        "customer_segment",
        "category",
        revenue().alias("revenue"),
        profit().alias("gross_profit"),
        items_count().alias("items"),
    )
    return top_k_per_group(rows, "customer_segment", "revenue", k, "category")


def segment_advice(summary: DataFrame) -> DataFrame:
    return summary.select("segment", "revenue", recode(F.col("segment"), TREATMENTS).alias("treatment"))
