"""What-if forecasts for every category, customer type, budget and discount at once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    ALL_CUSTOMERS,
    BUDGET_EFFECT,
    BUDGET_FLOOR,
    BUDGET_SCALE,
    BUDGETS,
    DEFAULT_BUDGET,
    DEFAULT_VOLUME_FACTOR,
    DISCOUNTS,
    REACH,
    SEGMENT_NAMES,
    UNKNOWN,
    VOLUME_FACTORS,
)
from ..functions.columns import at_least, log1p, lookup, money, ratio_pct, round_int, safe_ratio
from .categories import with_strategy
from .joins import with_category
from .totals import TOTALS, cost, revenue

BASE = ["items", "priced", "costed", "revenue_cents", "cost_cents"]


def category_segment_totals(by_product: DataFrame, products_tr: DataFrame) -> DataFrame:
    """Totals by category and segment. A segment without a plain name is still part of its category."""
    named = with_category(by_product, products_tr, "keep").filter(F.col("category") != UNKNOWN)
    sums = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in TOTALS]
    return named.groupBy("category", "customer_segment").agg(*sums, F.sum("margin_sum").alias("margin_sum"))


def _side_by_side(by_segment: DataFrame, segments, columns) -> DataFrame:
    """One row per category: each column for all customers and for each segment."""

    def pick(name, label=None):
        value = F.col(name) if label is None else F.when(F.col("customer_segment") == label, F.col(name))
        return F.sum(value)

    aggregates = [pick(c).alias(f"{c}_all") for c in columns]
    for n, label in enumerate(segments):
        aggregates += [pick(c, label).alias(f"{c}_{n}") for c in columns]
    return by_segment.groupBy("category").agg(*aggregates)


def _per_segment(wide: DataFrame, segments, *kept: str) -> DataFrame:
    """Units, mean price and mean cost of each choice of customers; a segment without a sale takes those of the category."""
    choices = [F.struct(F.lit(ALL_CUSTOMERS).alias("segment"), *[F.col(f"{c}_all").alias(c) for c in BASE])]
    for n, label in enumerate(segments):
        empty = F.coalesce(F.col(f"items_{n}"), F.lit(0)) == 0
        values = [F.when(empty, F.col(f"{c}_all")).otherwise(F.col(f"{c}_{n}")).alias(c) for c in BASE]
        choices.append(F.struct(F.lit(label).alias("segment"), *values))
    rows = wide.select("category", *kept, F.inline(F.array(*choices)))
    return rows.select(
        "category",
        "segment",
        *kept,
        F.col("items").cast("bigint").alias("base_units"),
        F.try_divide(revenue(), F.col("priced").cast("double")).alias("avg_price"),
        F.try_divide(cost(), F.col("costed").cast("double")).alias("avg_cost"),
    )


def base_stats(by_segment: DataFrame, segments=tuple(SEGMENT_NAMES.values())) -> DataFrame:
    """Units, mean price and mean cost per category for all customers and for each segment; a segment without a
    sale in the category takes the values of the category. One row per category holds all segments, so neither a
    grid nor a second pass is needed."""
    return _per_segment(_side_by_side(by_segment, segments, BASE), segments)


def advised_base_stats(by_segment: DataFrame, segments=tuple(SEGMENT_NAMES.values())) -> DataFrame:
    """base_stats with `what_to_do`, the strategy advice of the category over all its customers: worked out on the one row
    per category before its segments are unfolded, so the totals are made once and nothing is joined."""
    wide = _side_by_side(by_segment, segments, [*BASE, "profit_cents"]).withColumns(
        {"revenue": money(F.col("revenue_cents_all")), "profit": money(F.col("profit_cents_all"))}
    )
    return _per_segment(with_strategy(wide), segments, "what_to_do")


def scenario_grid(base: DataFrame, discounts=tuple(DISCOUNTS), budgets=tuple(BUDGETS)) -> DataFrame:
    """Every base row under every budget and discount: the two short lists are unfolded in place, nothing is joined."""
    budget_list = F.array(*[F.lit(b) for b in budgets])
    discount_list = F.array(*[F.lit(d) for d in discounts])
    return base.select("*", F.explode(budget_list).alias("budget")).select(
        "*", F.explode(discount_list).alias("discount_pct")
    )


def promotion_forecast(base: DataFrame, discounts=tuple(DISCOUNTS), budgets=tuple(BUDGETS)) -> DataFrame:
    budget, discount = F.col("budget"), F.col("discount_pct")
    volume = lookup(VOLUME_FACTORS, discount, DEFAULT_VOLUME_FACTOR)
    spread = F.lit(1.0) + F.lit(BUDGET_EFFECT) * log1p((budget - BUDGET_FLOOR) / F.lit(BUDGET_SCALE))
    expected = F.col("base_units").cast("double") * volume * spread * F.lit(REACH)
    return (
        scenario_grid(base, discounts, budgets)
        .withColumn("units", at_least(round_int(expected), 1).cast("bigint"))
        .withColumn("unit_price", F.col("avg_price") * (1 - discount / F.lit(100.0)))
        .withColumn("revenue", F.col("units") * F.col("unit_price"))
        .withColumn("cost", F.col("units") * F.col("avg_cost"))
        .withColumn("profit", F.col("revenue") - F.col("cost"))
        .withColumn("margin_pct", safe_ratio(F.col("profit"), F.col("revenue")) * 100)
        .withColumn("roi_pct", ratio_pct(F.col("profit") - budget, budget))
    )


def profit_curve(base: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    return promotion_forecast(base, budgets=(budget,)).select("category", "segment", "discount_pct", "profit")


def forecast_verdict(forecast: DataFrame) -> DataFrame:
    roi = F.col("roi_pct")
    return forecast.select(
        "category",
        "segment",
        "budget",
        "discount_pct",
        "roi_pct",
        F.when(roi < 0, "losing").when(roi > 100, "excellent").otherwise("moderate").alias("verdict"),
        (F.col("profit") > F.col("budget")).alias("profit_up"),
        (F.col("margin_pct") > 30).alias("margin_up"),
        (roi > 0).alias("roi_up"),
    )


def forecast_with_advice(by_segment: DataFrame, discounts=tuple(DISCOUNTS), budgets=tuple(BUDGETS)) -> DataFrame:
    """The strategy advice of its category next to every scenario, from one set of totals. Every customer has one segment, so
    the totals over all segments are also those of all known customers."""
    return promotion_forecast(advised_base_stats(by_segment), discounts, budgets).select(
        "category", "segment", "budget", "discount_pct", "profit", "roi_pct", "what_to_do"
    )
