"""Reports by product category. All start from totals per product, so the fact is aggregated once."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    ACTION_STEPS,
    ADS,
    FEWER_DISCOUNTS,
    FIX_MARGIN,
    GROW,
    HIGH_MARGIN_PCT,
    LOW_MARGIN_PCT,
    REVIEW,
    SMALL_DISCOUNTS,
    STOP,
    TEST,
    UNKNOWN,
)
from ..functions.columns import cents, money, recode
from .joins import with_campaign, with_category
from .relational import distinct_values, filter_opt, ranked, top_k, top_k_per_group, with_keys
from .totals import avg_margin_pct, items_count, profit, revenue, roll_up


def every_category():
    """Window over all categories; with one row per category it is as small as the report itself."""
    return Window.partitionBy(F.lit(1))


def category_totals(product_totals: DataFrame, products_tr: DataFrame, unknown: str = "drop") -> DataFrame:
    """unknown='drop' leaves products without a category out, 'keep' makes them one."""
    return roll_up(with_category(product_totals, products_tr, unknown), "category")


def known(totals: DataFrame) -> DataFrame:
    return totals.filter(F.col("category") != UNKNOWN)


def category_sums(totals: DataFrame) -> DataFrame:
    return totals.select("category", revenue().alias("revenue"), profit().alias("gross_profit"))


def top_categories_by_revenue(totals: DataFrame, k: int = 10) -> DataFrame:
    return top_k(category_sums(totals).select("category", "revenue"), "revenue", k, "category")


def top_categories_by_profit(totals: DataFrame, k: int = 10) -> DataFrame:
    return top_k(category_sums(totals).select("category", "gross_profit"), "gross_profit", k, "category")


def top_category_by_profit(totals: DataFrame) -> DataFrame:
    return top_categories_by_profit(totals, 1)


def category_performance(totals: DataFrame) -> DataFrame:
    return known(totals).select(
        "category",
        revenue().alias("revenue"),
        profit().alias("profit"),
        avg_margin_pct().alias("avg_margin_pct"),
        items_count().alias("volume"),
    )


def category_benchmarks(performance: DataFrame) -> DataFrame:
    """Median revenue and mean margin of the categories, and the quadrant each category falls into."""
    lined = performance.withColumns(
        {
            "revenue_line": F.median("revenue").over(every_category()),
            "margin_line": F.avg(F.col("avg_margin_pct").cast("decimal(24,6)")).over(every_category()).cast("double"),
        }
    )
    sales_side = F.when(F.col("revenue") >= F.col("revenue_line"), "high sales").otherwise("low sales")
    margin_side = F.when(F.col("avg_margin_pct") >= F.col("margin_line"), "high share").otherwise("low share")
    return lined.select(
        "category",
        "revenue",
        "avg_margin_pct",
        "revenue_line",
        "margin_line",
        F.concat_ws(", ", sales_side, margin_side).alias("quadrant"),
    )


def category_list(products_sold: DataFrame) -> DataFrame:
    return distinct_values(products_sold, "category")


def category_detail(totals: DataFrame, category: str | None = None) -> DataFrame:
    return filter_opt(totals, "category", category).select(
        "category",
        revenue().alias("revenue"),
        profit().alias("gross_profit"),
        avg_margin_pct().alias("avg_margin_pct"),
        items_count().alias("items"),
    )


def category_campaign(
    campaign_product_totals: DataFrame, products_tr: DataFrame, campaigns: DataFrame, category: str | None = None
) -> DataFrame:
    """By category, campaign name and discount; categories without a name are kept as unknown."""
    by_id = roll_up(with_category(campaign_product_totals, products_tr, "keep"), ["category", "campaign_id"])
    named = with_campaign(by_id, campaigns, ("campaign_name", "discount_pct"))
    return filter_opt(roll_up(named, ["category", "campaign_name", "discount_pct"]), "category", category).select(
        "category",
        "campaign_name",
        "discount_pct",
        revenue().alias("revenue"),
        profit().alias("gross_profit"),
        items_count().alias("items"),
    )


def product_performance(product_totals: DataFrame, products_tr: DataFrame, unknown: str = "drop") -> DataFrame:
    named = with_category(product_totals, products_tr, unknown)
    return with_keys(named, ["product_id", "category"]).select(
        "product_id",
        "category",
        revenue().alias("revenue"),
        profit().alias("gross_profit"),
        avg_margin_pct().alias("avg_margin_pct"),
    )


def top_products_by_category(product_totals: DataFrame, products_tr: DataFrame, k: int = 10) -> DataFrame:
    return top_k(product_performance(product_totals, products_tr), "gross_profit", k, ["product_id", "category"])


def top_products_in_category(
    product_totals: DataFrame, products_tr: DataFrame, k: int = 5, category: str | None = None
) -> DataFrame:
    rows = filter_opt(known(product_performance(product_totals, products_tr)), "category", category)
    return top_k_per_group(rows, "category", "gross_profit", k, "product_id")


def category_margin_advice(totals: DataFrame, low=LOW_MARGIN_PCT, high=HIGH_MARGIN_PCT) -> DataFrame:
    margin = F.col("avg_margin_pct")
    advice = F.when(margin < low, "stop discounts").when(margin > high, "small discount").otherwise("hold prices")
    return known(totals).select("category", avg_margin_pct().alias("avg_margin_pct")).withColumn("advice", advice)


def marketing_insights(totals: DataFrame) -> DataFrame:
    """Best category by revenue and best by profit in one row."""
    sums = category_sums(totals)

    def first_by(measure):
        # Smallest of (-measure, category): the highest measure, equal measures in name order.
        order = F.struct(-F.col(measure), F.col("category"))
        return F.min_by("category", order)

    return sums.agg(
        first_by("revenue").alias("top_revenue_category"),
        F.max("revenue").alias("top_revenue"),
        first_by("gross_profit").alias("top_profit_category"),
        F.max("gross_profit").alias("top_profit"),
    ).filter(F.col("top_revenue_category").isNotNull())


def with_benchmark(groups: DataFrame, cols=("revenue", "profit")) -> DataFrame:
    """Mean of the group totals next to every group, and on which side of it the group lies: 1, 0 or -1, compared in
    whole cents so that a group equal to the mean is seen as equal."""
    benchmarked = {}
    for c in cols:
        own = cents(F.col(c)).cast("decimal(28,0)")
        whole = F.sum(own).over(every_category())
        n = F.count(c).over(every_category())
        benchmarked[f"mean_{c}"] = F.try_divide(money(whole.cast("decimal(36,0)")), n)
        benchmarked[f"side_{c}"] = F.signum((own * n - whole).cast("double")).cast("int")
    return groups.withColumns(benchmarked)


def _category_summary(totals: DataFrame) -> DataFrame:
    return totals.select(
        "category",
        revenue().alias("revenue"),
        profit().alias("profit"),
        avg_margin_pct().alias("avg_margin_pct"),
    )


def promotion_recommendations(totals: DataFrame, k: int | None = 15) -> DataFrame:
    """Strict comparison with the mean category; a category equal to a mean is to be tested."""
    sales, gain = F.col("side_revenue"), F.col("side_profit")
    rule = (
        F.when((sales > 0) & (gain > 0), GROW)
        .when((sales > 0) & (gain < 0), FIX_MARGIN)
        .when((sales < 0) & (gain < 0), REVIEW)
        .otherwise(TEST)
    )
    rows = with_benchmark(_category_summary(totals)).select(
        "category", "revenue", "profit", "avg_margin_pct", rule.alias("recommendation")
    )
    return ranked(rows, "profit", "category") if k is None else top_k(rows, "profit", k, "category")


def with_strategy(rows: DataFrame) -> DataFrame:
    """`what_to_do` for categories with revenue and profit, one row each. As the strict rule, but a category equal to a mean
    counts as not above it."""
    sales, gain = F.col("side_revenue"), F.col("side_profit")
    rule = (
        F.when((sales > 0) & (gain > 0), ADS)
        .when((sales > 0) & (gain <= 0), FEWER_DISCOUNTS)
        .when((sales <= 0) & (gain <= 0), STOP)
        .otherwise(SMALL_DISCOUNTS)
    )
    return with_benchmark(rows).withColumn("what_to_do", rule)


def strategy_advice(totals: DataFrame, action: str | None = None) -> DataFrame:
    """The advice for every category; unknown is left out first."""
    rows = with_strategy(_category_summary(known(totals))).select(
        "category", "revenue", "profit", "avg_margin_pct", "what_to_do"
    )
    rows = rows.withColumn("action_steps", recode(F.col("what_to_do"), ACTION_STEPS))
    return ranked(filter_opt(rows, "what_to_do", action), "profit", "category")
