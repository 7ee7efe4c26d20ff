"""Reports by campaign and channel."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CAMPAIGN_IDS
from ..functions.columns import cents, draw_choice, money, ratio_pct
from .joins import with_campaign, with_campaign_id
from .relational import ranked, with_keys
from .totals import key_totals, order_totals, orders_count, product_totals, profit, revenue, roi_pct


def mapped(sales: DataFrame, mapping: DataFrame) -> DataFrame:
    return with_keys(with_campaign_id(sales, mapping), "campaign_id")


def campaign_product_totals(sales: DataFrame, mapping: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """Totals by campaign and product through the order-to-campaign mapping."""
    return product_totals(mapped(sales, mapping), costs, ["campaign_id"])


def campaign_totals(sales: DataFrame, mapping: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    return key_totals(mapped(sales, mapping), costs, ["campaign_id"])


def drawn_campaign_totals(sales: DataFrame, costs: DataFrame | None = None, campaign_ids=CAMPAIGN_IDS) -> DataFrame:
    """The same for a drawn mapping, which is a function of order_id: no join, so the fact is not shuffled at all.
    Equal to the join where every item's order exists."""
    drawn = sales.withColumn("campaign_id", draw_choice(F.col("order_id"), campaign_ids))
    return key_totals(with_keys(drawn, "campaign_id"), costs, ["campaign_id"])


def campaign_order_totals(sales: DataFrame, mapping: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """Totals by campaign with distinct orders."""
    return order_totals(mapped(sales, mapping), costs, ["campaign_id"])


def _returns(totals: DataFrame, campaigns: DataFrame, *further) -> DataFrame:
    rows = with_campaign(totals, campaigns).select(
        "campaign_id",
        "campaign_name",
        "channel",
        "discount_pct",
        "budget",
        revenue().alias("revenue"),
        profit().alias("gross_profit"),
        roi_pct(F.col("budget")).alias("roi_pct"),
        *further,
    )
    return ranked(rows, "roi_pct", "campaign_id")


def campaign_roi(totals: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Campaigns with sales, best return on budget first."""
    return _returns(totals, campaigns)


def campaign_performance(totals: DataFrame, campaigns: DataFrame) -> DataFrame:
    """campaign_roi with the distinct orders of each campaign, from totals with orders."""
    return _returns(totals, campaigns, orders_count().alias("total_orders"))


def _order_by(measure: str, sign: int = 1, key: str = "campaign_id"):
    """Sort position of a campaign by a measure (largest first for sign 1), ties by key; NULL where unmeasured."""
    value = F.col(measure)
    return F.when(value.isNotNull(), F.struct(-value if sign > 0 else value, F.col(key)))


def campaign_kpis(roi: DataFrame) -> DataFrame:
    best, worst = _order_by("roi_pct"), _order_by("roi_pct")
    return roi.agg(
        F.min_by("campaign_name", best).alias("best_campaign"),
        F.max("roi_pct").alias("best_roi_pct"),
        F.max_by("campaign_name", worst).alias("worst_campaign"),
        F.min("roi_pct").alias("worst_roi_pct"),
        F.min_by("campaign_name", _order_by("gross_profit")).alias("max_profit_campaign"),
        F.max("gross_profit").alias("max_profit"),
        F.sum("budget").alias("total_budget"),
    )


def channel_roi(roi: DataFrame) -> DataFrame:
    by_channel = roi.filter(F.col("channel").isNotNull()).groupBy("channel").agg(
        money(F.sum(cents(F.col("gross_profit")))).alias("gross_profit"), F.sum("budget").alias("budget")
    )
    return by_channel.withColumn("roi_pct", ratio_pct(F.col("gross_profit") - F.col("budget"), F.col("budget")))


def campaign_verdict(roi: DataFrame) -> DataFrame:
    """The campaign to repeat and the one to stop or watch."""
    kpis = campaign_kpis(roi)
    worst = F.col("worst_roi_pct")
    rows = F.array(
        F.struct(
            F.lit("best").alias("place"),
            F.col("best_campaign").alias("campaign_name"),
            F.col("best_roi_pct").alias("roi_pct"),
            F.lit("repeat").alias("verdict"),
        ),
        F.struct(
            F.lit("worst").alias("place"),
            F.col("worst_campaign").alias("campaign_name"),
            worst.alias("roi_pct"),
            F.when(worst < 0, "stop").otherwise("watch").alias("verdict"),
        ),
    )
    return kpis.filter(F.col("best_campaign").isNotNull()).select(F.inline(rows))
