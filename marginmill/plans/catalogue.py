"""The registered queries: each maps a Shop to a DataFrame."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import ADS, SEGMENT_NAMES
from ..functions import columns as fn
from ..operators import (
    answers,
    campaigns,
    categories,
    distinct,
    features,
    forecast,
    joins,
    kpis,
    pricing,
    relational,
    segments,
    statistics,
)
from ..sources import tables
from .shop import Shop, bind_star_schema

# A question in SQL as a user may paste it, code fences included.
ADHOC_QUESTION = """```sql
SELECT product_id, COUNT(*) AS items, COUNT(DISTINCT order_id) AS orders
FROM order_items
GROUP BY product_id
ORDER BY items DESC, product_id
```"""


def adhoc(shop: Shop) -> DataFrame:
    spark = shop.items.sparkSession
    return answers.adhoc_sql(spark, ADHOC_QUESTION, shop.raw_tables())


def compared(df: DataFrame, cols=None) -> DataFrame:
    """Doubles at six decimals: what two engines agree on for sums in another order. Operators do not round."""
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double" and (cols is None or f.name in cols)]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


def campaigns_used(shop: Shop) -> DataFrame:
    """The campaign table with the orders drawn for each."""
    drawn = relational.group_agg(shop.mapping, "campaign_id", counts={"orders": "order_id"})
    return shop.campaigns.join(drawn, "campaign_id", "left")


# Reports (Q01-Q55).
REPORTS: dict[str, Callable[[Shop], DataFrame]] = {
    "q01_total_orders": lambda s: kpis.total_orders(s.orders),
    "q02_total_payments": lambda s: kpis.total_payments(s.payments),
    "q03_product_costs": lambda s: s.costs,
    "q04_campaigns_used": campaigns_used,
    "q05_campaign_mapping": lambda s: s.mapping,
    "q06_sales_features": lambda s: s.sales,
    "q07_sales_stats": lambda s: compared(features.sales_stats(s.sales_with())),
    "q08_customer_segments": lambda s: s.segments,
    "q09_segment_counts": lambda s: features.segment_counts(s.segments),
    "q10_kpi_summary": lambda s: kpis.kpi_summary(s.whole_totals),
    "q11_executive_kpis": lambda s: kpis.executive_kpis(s.fact, s.fact_orders, s.fact_costs),
    "q12_top_products": lambda s: kpis.top_products(s.product_totals),
    "q13_top_products_by_category": lambda s: categories.top_products_by_category(
        s.ordered_product_totals, s.products_tr
    ),
    "q14_monthly_trend": lambda s: kpis.monthly_trend(s.fact, s.fact_orders, *s.months, s.fact_costs),
    "q15_cost_profit_split": lambda s: kpis.cost_profit_split(s.ordered_product_totals),
    "q16_top_category_by_profit": lambda s: categories.top_category_by_profit(s.ordered_category_totals),
    "q17_margin_health": lambda s: kpis.margin_health(s.ordered_product_totals),
    "q18_top_categories_by_revenue": lambda s: categories.top_categories_by_revenue(s.category_totals),
    "q19_top_categories_by_profit": lambda s: categories.top_categories_by_profit(s.category_totals),
    "q20_category_performance": lambda s: categories.category_performance(s.category_totals_with_unknown),
    "q21_category_benchmarks": lambda s: compared(
        categories.category_benchmarks(categories.category_performance(s.category_totals)), ["margin_line"]
    ),
    "q22_category_list": lambda s: categories.category_list(
        joins.with_category(s.items.select("product_id").distinct(), s.products_tr)
    ),
    "q23_category_detail": lambda s: categories.category_detail(s.category_totals_with_unknown),
    "q24_category_campaign": lambda s: categories.category_campaign(
        s.campaign_product_totals, s.products_tr, s.campaigns
    ),
    "q25_top_products_in_category": lambda s: categories.top_products_in_category(s.product_totals, s.products_tr),
    "q26_category_margin_advice": lambda s: categories.category_margin_advice(s.category_totals),
    "q27_marketing_insights": lambda s: categories.marketing_insights(s.category_totals),
    "q28_promotion_recommendations": lambda s: categories.promotion_recommendations(s.category_totals),
    "q29_strategy_advice": lambda s: categories.strategy_advice(s.customer_category_totals),
    "q30_segment_profitability": lambda s: segments.segment_profitability(s.segment_totals("left")),
    "q31_best_segment": lambda s: segments.best_segment(
        segments.segment_profitability(s.segment_totals("left"))
    ),
    "q32_segment_summary": lambda s: s.segment_summary(plain_names=True),
    "q33_segment_top_categories": lambda s: segments.segment_top_categories(
        s.segment_product_totals, s.products_tr
    ),
    "q34_segment_advice": lambda s: segments.segment_advice(s.segment_summary(plain_names=True)),
    "q35_campaign_roi": lambda s: s.campaign_roi,
    "q35_campaign_roi_drawn": lambda s: campaigns.campaign_roi(
        campaigns.drawn_campaign_totals(s.fact, s.fact_costs), s.campaigns
    ),
    "q36_campaign_performance": lambda s: campaigns.campaign_performance(s.campaign_order_totals, s.campaigns),
    "q37_campaign_kpis": lambda s: campaigns.campaign_kpis(s.campaign_roi),
    "q38_channel_roi": lambda s: campaigns.channel_roi(s.campaign_roi),
    "q39_campaign_verdict": lambda s: campaigns.campaign_verdict(s.campaign_roi),
    "q40_discount_effectiveness": lambda s: pricing.discount_effectiveness(s.discount_totals),
    "q40_recommended_discount": lambda s: pricing.recommended_discount(
        pricing.discount_effectiveness(s.discount_totals)
    ),
    "q41_discount_performance": lambda s: s.discount_performance,
    "q42_discount_kpis": lambda s: pricing.discount_kpis(s.discount_performance),
    "q43_discount_volume_change": lambda s: pricing.discount_volume_change(s.discount_performance),
    "q44_promotion_forecast": lambda s: forecast.promotion_forecast(s.forecast_base),
    "q45_profit_curve": lambda s: forecast.profit_curve(s.forecast_base),
    "q46_forecast_verdict": lambda s: forecast.forecast_verdict(forecast.promotion_forecast(s.forecast_base)),
    "q47_forecast_with_advice": lambda s: forecast.forecast_with_advice(s.category_segment_totals),
    "q48_answer_discount": lambda s: answers.answer_discount(s.discount_performance),
    "q49_answer_campaigns": lambda s: answers.answer_campaigns(s.campaign_roi),
    "q50_answer_segments": lambda s: answers.answer_segments(s.segment_summary(plain_names=False)),
    "q51_answer_categories": lambda s: answers.answer_categories(s.category_totals_with_unknown),
    "q52_answer_kpis": lambda s: answers.answer_kpis(kpis.kpi_summary(s.whole_totals)),
    "q53_adhoc_sql": adhoc,
    "q54_tag_intents": lambda s: answers.tag_intents(s.questions).drop("text"),
    "q54_intent_counts": lambda s: answers.intent_counts(answers.tag_intents(s.questions)),
    "q55_apply_glossary": lambda s: answers.apply_glossary(s.turns),
}

# Scans and joins (S, J) at the grain of the item.
RELATIONS: dict[str, Callable[[Shop], DataFrame]] = {
    "s1_read_items": lambda s: s.items,
    "s2_profile": lambda s: tables.profile_all(s.raw_tables()),
    "s2_preview": lambda s: tables.preview(s.items),
    "s7_sql_select": lambda s: sql_report(s),
    "j2_sales_campaign_id": lambda s: joins.with_campaign_id(s.items, s.mapping),
    "j3_sales_campaign": lambda s: joins.with_campaign(joins.with_campaign_id(s.items, s.mapping), s.campaigns),
    "j4_sales_category": lambda s: joins.with_category(s.items, s.products_tr),
    "j5_products_translated": lambda s: s.products_tr,
    "j6_sales_orders_inner": lambda s: joins.with_orders(s.items, s.orders),
    "j7_sales_orders_left": lambda s: joins.with_orders(s.items, s.orders, "left"),
    "j8_sales_segment_inner": lambda s: joins.with_segment(joins.with_orders(s.items, s.orders), s.segments),
    "j9_sales_segment_left": lambda s: joins.with_segment(
        joins.with_orders(s.items, s.orders, "left"), s.segments, "left"
    ),
    "j10_customers_with_spend": lambda s: features.customers_with_spend(
        s.customers, features.customer_spend(s.items, s.orders, "price")
    ),
    "j12_with_benchmark": lambda s: categories.with_benchmark(
        categories.category_performance(s.category_totals)
    ).drop("side_revenue", "side_profit"),
    "j13_sales_wide": lambda s: s.wide,
}


def sql_report(shop: Shop) -> DataFrame:
    text = "SELECT ROUND(SUM(payment_value), 2) AS paid, COUNT(*) AS payments FROM {payments}"
    return tables.sql_select(shop.items.sparkSession, text, payments=shop.payments)


def per_item(shop: Shop, name: str, column: Callable) -> DataFrame:
    """One computed column for every item; the function is called once the session is up."""
    return shop.items.select("order_id", "product_id", "item_no", column().alias(name))


def per_turn(shop: Shop, name: str, column: Callable) -> DataFrame:
    return shop.turns.select("conv_id", "turn", column(F.col("text")).alias(name))


def placed_month() -> Column:
    return fn.month_key(F.col("order_purchase_timestamp")).alias("month")


def price_size() -> Column:
    price = F.col("price")
    return F.when(price >= 60000, "large").when(price >= 30000, "medium").otherwise("small")


# Projections, filters and rules (P) over whole tables.
PROJECTIONS: dict[str, Callable[[Shop], DataFrame]] = {
    "p1_select": lambda s: s.orders.select("order_id", "customer_id"),
    "p3_rename": lambda s: relational.group_agg(
        s.items, "product_id", sums={"r": "price"}, counts={"n": "order_id"}, digits=2
    ).toDF("product", "revenue", "units"),
    "p4_filter_and": lambda s: s.items.filter((F.col("item_no") == 1) & (F.col("price") > 50000)),
    "p5_filter_not_unknown": lambda s: categories.known(relational.fill_unknown(s.products_tr, "category")),
    "p6_month_range": lambda s: relational.month_range(s.orders, "order_purchase_timestamp", *s.months).select(
        "order_id", placed_month()
    ),
    "p7_fill_unknown": lambda s: relational.fill_unknown(s.products_tr, "category"),
    "p8_recode": lambda s: s.segments.select(
        "customer_id", fn.recode(F.col("customer_segment"), SEGMENT_NAMES).alias("customer_type")
    ),
    "p9_rule": lambda s: s.items.withColumn("size", price_size()),
    "p10_filter_optional": lambda s: relational.filter_opt(
        relational.filter_opt(s.items, "item_no", 2), "product_id"
    ),
    "p10_advice_filtered": lambda s: categories.strategy_advice(s.category_totals, ADS),
    "p12_percent_label": lambda s: pricing.discount_labels(s.discount_performance),
    "p13_distinct_values": lambda s: relational.distinct_values(
        relational.fill_unknown(s.products_tr, "category"), "category"
    ),
    "p14_top1": lambda s: relational.top1(s.items, "price", ["order_id", "product_id", "item_no"]),
    "p15_keyed_lookup": lambda s: pricing.discount_volume_change(s.discount_performance, 10, 20),
}

# Aggregates, sorts and top-k (A, O) over whole tables.
AGGREGATES: dict[str, Callable[[Shop], DataFrame]] = {
    "a1_total": lambda s: relational.total(s.items, "price", digits=2),
    "a2_mean": lambda s: compared(relational.mean(s.sales_with(), "profit_margin_pct")),
    "a3_n_distinct": lambda s: relational.n_distinct(s.items, "order_id"),
    "a4_distinct_by_sketch": lambda s: distinct.reach_checked(s.sales_keys, s.reach_sketches, *s.months),
    "a4_group_distinct": lambda s: relational.group_agg(s.items, "product_id", distinct={"orders": "order_id"}),
    "a5_group_count": lambda s: relational.group_agg(s.items, "product_id", counts={"items": "price"}),
    "a6_row_count": lambda s: relational.row_count(s.items),
    "a7_group_agg": lambda s: compared(
        relational.group_agg(
            s.sales_with(),
            "product_id",
            sums={"revenue": "revenue", "gross_profit": "gross_profit"},
            means={"avg_margin_pct": "profit_margin_pct"},
            counts={"items": "order_id"},
            digits=2,
        ),
        ["avg_margin_pct"],
    ),
    "a8_group_two_keys": lambda s: relational.group_agg(s.items, ["product_id", "item_no"], sums={"revenue": "price"}, digits=2),
    "a9_group_sum": lambda s: relational.group_sum(s.items, "order_id", "price", digits=2),
    "a10_named_mean": lambda s: relational.group_agg(
        joins.with_orders(s.items, s.orders), "customer_id", money_means={"avg_spend": "price"}
    ),
    "a11_median": lambda s: compared(statistics.median(s.items, "price")),
    "a12_arg_max": lambda s: relational.arg_max(
        relational.group_sum(s.items, "product_id", "price", digits=2), "product_id", "price"
    ),
    "a13_ratio_of_sums": lambda s: relational.ratio_of_sums(
        s.sales_with("item_no"), "item_no", "gross_profit", "revenue", "margin_pct", digits=2
    ),
    "a14_benchmark": lambda s: relational.benchmark(
        categories.category_performance(s.category_totals), ["revenue", "profit"], digits=2
    ),
    "a15_describe": lambda s: compared(statistics.describe(s.payments, ["payment_value"])),
    "a16_value_counts": lambda s: relational.value_counts(s.items, "product_id"),
    "a17_round_cols": lambda s: relational.round_cols(
        relational.group_agg(s.items, "item_no", money_means={"avg_price": "price"}), "avg_price"
    ),
    "a19_mixed_mean": lambda s: relational.group_agg(
        s.items, "item_no", sums={"revenue": "price"}, money_means={"avg_price": "price"}, distinct={"orders": "order_id"}, digits=2
    ),
    "o1_ranked": lambda s: relational.ranked(s.payments, "payment_value", "order_id"),
    "o2_ordered": lambda s: relational.ordered(s.payments, ["payment_value", "order_id"]),
    "o3_top_k": lambda s: relational.top_k(
        relational.group_sum(s.items, "order_id", "price", digits=2), "price", 15, "order_id"
    ),
    "o4_top_k_per_group": lambda s: relational.top_k_per_group(
        s.items, "product_id", "price", 3, ["order_id", "item_no"]
    ),
}

# Scalar functions (F) over whole tables.
SCALARS: dict[str, Callable[[Shop], DataFrame]] = {
    "f1_bround2": lambda s: per_item(s, "third", lambda: fn.bround2(F.col("price") * 0.333)),
    "f2_round_int": lambda s: per_item(s, "half", lambda: fn.round_int(F.col("price") * 0.5)),
    "f3_log1p": lambda s: per_item(s, "log_price", lambda: F.round(fn.log1p(F.col("price")), 9)),
    "f4_at_least": lambda s: per_item(s, "at_least_3", lambda: fn.at_least(F.col("item_no"), 3)),
    "f5_safe_ratio": lambda s: per_item(s, "ratio", lambda: fn.safe_ratio(F.col("price"), F.col("item_no") - 1)),
    "f6_to_ts": lambda s: s.orders.select(
        "order_id", fn.to_ts(F.col("order_purchase_timestamp").cast("string")).alias("placed")
    ),
    "f7_month_key": lambda s: s.orders.select("order_id", placed_month()),
    "f8_contains_any": lambda s: per_turn(s, "hit", lambda text: fn.contains_any(text, ["the", "und", "que"])),
    "f9_replace_all": lambda s: per_turn(
        s, "text", lambda text: fn.replace_all(text, [("an", "on"), ("on", "in")])
    ),
    "f10_lookup": lambda s: per_item(
        s, "place", lambda: fn.lookup({1: "first", 2: "second"}, F.col("item_no"), "later")
    ),
    "f11_pct_change": lambda s: s.sales_with("item_no").select(
        "order_id", "product_id", "item_no", fn.pct_change(F.col("cost_price"), F.col("price")).alias("change_pct")
    ),
    "f12_keyed_draw": lambda s: s.orders.select("order_id", fn.keyed_draw(F.col("order_id")).alias("draw")),
    "f13_title": lambda s: per_turn(s, "text", fn.title),
}

CATALOGUE = {**REPORTS, **RELATIONS, **PROJECTIONS, **AGGREGATES, **SCALARS}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(report):
        return lambda spark, directory: report(bind_star_schema(spark, directory))

    return {name: over(report) for name, report in CATALOGUE.items()}
