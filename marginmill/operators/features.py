"""Derived tables: product costs, campaign mapping, sales fact, customer segments."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CAMPAIGN_IDS, LOWEST_SEGMENT, SEGMENT_THRESHOLDS
from ..functions.columns import cents, draw_choice, money, ratio_pct
from .relational import spread_join, value_counts, with_keys
from .statistics import describe
from .totals import costs_of, item_totals


def product_costs(items: DataFrame) -> DataFrame:
    return costs_of(item_totals(with_keys(items, "product_id"), "product_id"))


def campaign_mapping(orders: DataFrame, campaign_ids=CAMPAIGN_IDS) -> DataFrame:
    """One campaign for every order, drawn from the order's key."""
    return orders.select("order_id", draw_choice(F.col("order_id"), campaign_ids).alias("campaign_id"))


def with_costs(items: DataFrame, costs: DataFrame) -> DataFrame:
    """`costs` may bring further columns of the product along."""
    return spread_join(items, costs, "product_id")


def sales_features(items: DataFrame, costs: DataFrame) -> DataFrame:
    """Every item with cost, revenue, profit and margin; the margin of a free item is NULL."""
    further = [c for c in costs.columns if c not in ("product_id", "cost_price")]
    gross_profit = F.col("price") - F.col("cost_price")
    return with_costs(items, costs).select(
        *items.columns,
        "cost_price",
        F.col("price").alias("revenue"),
        gross_profit.alias("gross_profit"),
        ratio_pct(gross_profit, F.col("price")).alias("profit_margin_pct"),
        *further,
    )


def sales_stats(sales: DataFrame) -> DataFrame:
    return describe(sales, ["revenue", "cost_price", "gross_profit"])


def customer_spend(sales: DataFrame, orders: DataFrame, spend: str = "revenue") -> DataFrame:
    """Mean item spend per customer. Items are summed per order before they meet the orders."""
    per_order = with_keys(sales, "order_id").groupBy("order_id").agg(
        F.sum(cents(F.col(spend))).alias("spend_cents"), F.count(spend).alias("n")
    )
    per_customer = (
        with_keys(per_order.join(orders.select("order_id", "customer_id"), "order_id"), "customer_id")
        .groupBy("customer_id")
        .agg(F.sum("spend_cents").alias("spend_cents"), F.sum("n").alias("n"))
    )
    return per_customer.select(
        "customer_id", F.try_divide(money(F.col("spend_cents")), F.col("n")).alias("avg_spend")
    )


def customers_with_spend(customers: DataFrame, stats: DataFrame) -> DataFrame:
    """All customers; those without a spend get 0."""
    joined = customers.join(stats, "customer_id", "left")
    return joined.withColumn("avg_spend", F.coalesce("avg_spend", F.lit(0.0)))


def segment_of(avg_spend, thresholds=SEGMENT_THRESHOLDS, lowest=LOWEST_SEGMENT):
    (limit, label), *rest = thresholds
    rule = F.when(avg_spend >= limit, label)
    for limit, label in rest:
        rule = rule.when(avg_spend >= limit, label)
    return rule.otherwise(lowest)


def customer_segments(
    sales: DataFrame, orders: DataFrame, customers: DataFrame, thresholds=SEGMENT_THRESHOLDS, spend: str = "revenue"
) -> DataFrame:
    spenders = customers_with_spend(customers, customer_spend(sales, orders, spend))
    return spenders.select(
        "customer_id", "customer_unique_id", segment_of(F.col("avg_spend"), thresholds).alias("customer_segment")
    )


def segment_counts(segments: DataFrame) -> DataFrame:
    return value_counts(segments, "customer_segment", "customers")
