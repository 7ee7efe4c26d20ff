"""Reports by discount. A discount belongs to a campaign, so they are computed from campaign totals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pct_change, percent_label
from .joins import with_campaign
from .relational import ordered, ranked, top1
from .totals import items_count, margin_pct, profit, revenue, roll_up


def discount_totals(campaign_totals: DataFrame, campaigns: DataFrame) -> DataFrame:
    return roll_up(with_campaign(campaign_totals, campaigns, ("discount_pct",)), "discount_pct")


def discount_effectiveness(totals: DataFrame) -> DataFrame:
    """Most profitable discount first."""
    rows = totals.select(
        "discount_pct",
        revenue().alias("revenue"),
        profit().alias("gross_profit"),
        margin_pct().alias("margin_pct"),
    )
    return ranked(rows, "gross_profit", "discount_pct")


def recommended_discount(effectiveness: DataFrame) -> DataFrame:
    return top1(effectiveness, "gross_profit", "discount_pct").select("discount_pct", "gross_profit")


def discount_performance(totals: DataFrame) -> DataFrame:
    rows = totals.select(
        "discount_pct",
        revenue().alias("revenue"),
        profit().alias("profit"),
        items_count().alias("units_sold"),
        margin_pct().alias("margin_pct"),
    )
    return ordered(rows, "discount_pct")


def discount_kpis(performance: DataFrame) -> DataFrame:
    """The discount of the highest profit and the discount of the highest margin."""

    def first_by(measure):
        value = F.col(measure)
        return F.min_by("discount_pct", F.when(value.isNotNull(), F.struct(-value, F.col("discount_pct"))))

    return performance.agg(
        first_by("profit").alias("best_profit_discount_pct"),
        F.max("profit").alias("best_profit"),
        first_by("margin_pct").alias("best_margin_discount_pct"),
        F.max("margin_pct").alias("best_margin_pct"),
    )


def discount_volume_change(performance: DataFrame, low: int = 5, high: int = 25) -> DataFrame:
    """Units at two discounts and the change between them, NULL where a discount was never given."""

    def units_at(discount):
        return F.max(F.when(F.col("discount_pct") == discount, F.col("units_sold")))

    return performance.agg(units_at(low).alias("units_low"), units_at(high).alias("units_high")).withColumn(
        "change_pct", pct_change(F.col("units_low"), F.col("units_high"))
    )


def discount_labels(performance: DataFrame) -> DataFrame:
    return performance.withColumn("discount", percent_label(F.col("discount_pct")))
