"""Shop-level figures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cents, money, month_key, ratio_pct, safe_ratio
from .relational import ordered, top_k, with_keys
from .joins import in_months, with_orders
from .totals import avg_margin_pct, cost, key_totals, margin_pct, order_totals, orders_count, profit, revenue, roll_up


def total_orders(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count(F.lit(1)).alias("total_orders"))


def total_payments(payments: DataFrame) -> DataFrame:
    return payments.agg(F.round(money(F.sum(cents(F.col("payment_value")))), 2).alias("total_revenue"))


def kpi_summary(totals: DataFrame) -> DataFrame:
    """Revenue, profit and mean margin of everything sold, with the number of distinct orders. Totals with orders."""
    return roll_up(totals, (), ("orders",)).select(
        revenue().alias("total_revenue"),
        profit().alias("total_profit"),
        avg_margin_pct().alias("avg_margin_pct"),
        orders_count().alias("total_orders"),
    )


def executive_kpis(sales: DataFrame, orders: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """As kpi_summary for items whose order exists, with cost and average order value."""
    return order_totals(with_orders(sales, orders, cols=()), costs).select(
        revenue().alias("total_revenue"),
        profit().alias("total_profit"),
        avg_margin_pct().alias("avg_margin_pct"),
        cost().alias("total_cost"),
        orders_count().alias("total_orders"),
    ).withColumn("aov", safe_ratio(F.col("total_revenue"), F.col("total_orders")))


def top_products(product_totals: DataFrame, k: int = 10) -> DataFrame:
    rows = with_keys(product_totals, "product_id").select("product_id", profit().alias("gross_profit"))
    return top_k(rows, "gross_profit", k, "product_id")


def monthly_trend(
    sales: DataFrame, orders: DataFrame, low: str, high: str, costs: DataFrame | None = None
) -> DataFrame:
    """Revenue and profit per month of [low, high], given as 'yyyy-MM'."""
    monthly = key_totals(in_months(sales, orders, low, high), costs, ["month_start"])
    return ordered(
        monthly.select(
            month_key(F.col("month_start")).alias("month"),
            revenue().alias("revenue"),
            profit().alias("gross_profit"),
        ),
        "month",
    )


def cost_profit_split(totals: DataFrame) -> DataFrame:
    """Two rows: what the items cost and what was kept, each with its share."""
    whole = cost() + profit()
    parts = F.array(
        F.struct(F.lit("cost").alias("part"), cost().alias("amount"), ratio_pct(cost(), whole).alias("share_pct")),
        F.struct(F.lit("profit").alias("part"), profit().alias("amount"), ratio_pct(profit(), whole).alias("share_pct")),
    )
    return roll_up(totals).select(F.inline(parts))


def margin_health(totals: DataFrame, limit: float = 40) -> DataFrame:
    """Ratio of sums: below the limit the margin is low, otherwise good."""
    margin = F.col("margin_pct")
    return (
        roll_up(totals)
        .select(revenue().alias("total_revenue"), profit().alias("total_profit"), margin_pct().alias("margin_pct"))
        .withColumn("health", F.when(margin < limit, "low").when(margin.isNotNull(), "good"))
    )
