"""Hand-made rows for the rules that test data alone does not reach."""

import pytest
from pyspark.sql import functions as F

from marginmill.fixed_values import ADS, FEWER_DISCOUNTS, SMALL_DISCOUNTS, STOP
from marginmill.operators import campaigns, categories, features, forecast, kpis, pricing, relational, segments, statistics
from marginmill.operators import totals as tot
from marginmill.operators.joins import with_orders

from .conftest import rows_of


def test_missing_cost_and_free_item(make_shop):
    shop = make_shop(
        costs=[("p1", 4.0)],
        order_items=[("o1", "p1", 10.0), ("o1", "p2", 5.0), ("o2", "p1", 0.0), ("o3", "p1", None)],
    )
    rows = {(r.order_id, r.product_id): r for r in shop.sales.collect()}
    assert rows["o1", "p2"].gross_profit is None and rows["o1", "p2"].profit_margin_pct is None
    assert rows["o2", "p1"].gross_profit == -4.0 and rows["o2", "p1"].profit_margin_pct is None
    by_product = {r.product_id: r for r in tot.product_totals(shop.items, shop.costs).collect()}
    assert by_product["p2"].profit_cents == 0 and by_product["p2"].margin_rows == 0
    assert (by_product["p1"].revenue_cents, by_product["p1"].profit_cents, by_product["p1"].cost_cents) == (1000, 200, 1200)
    # The totals of the stored fact and those of raw items and costs are the same.
    stored = {r.product_id: r for r in tot.product_totals(shop.sales).collect()}
    for name, r in by_product.items():
        for c in tot.TOTALS:
            assert r[c] == stored[name][c], (name, c)
    kpi = kpis.kpi_summary(shop.whole_totals).first()
    assert kpi.asDict() == {"total_revenue": 15.0, "total_profit": 2.0, "avg_margin_pct": 60.0, "total_orders": 3}


def test_empty_shop(make_shop):
    kpi = kpis.executive_kpis(make_shop(costs=[]).items, make_shop().orders, make_shop(costs=[]).costs).first()
    assert (kpi.total_revenue, kpi.total_orders, kpi.aov, kpi.avg_margin_pct) == (0.0, 0, 0.0, None)
    assert categories.marketing_insights(make_shop().category_totals).count() == 0


def test_item_without_order_counts_only_in_the_whole(make_shop):
    shop = make_shop(
        costs=[("p1", 4.0)],
        order_items=[("o1", "p1", 10.0), ("lost", "p1", 7.0)],
        orders=[("o1", "c1", None)],
    )
    assert kpis.kpi_summary(tot.order_totals(shop.items, shop.costs)).first().total_revenue == 17.0
    executive = kpis.executive_kpis(shop.items, shop.orders, shop.costs).first()
    assert (executive.total_revenue, executive.total_orders, executive.aov) == (10.0, 1, 10.0)
    assert with_orders(shop.items, shop.orders, "left").count() == 2


def test_item_without_product_stays_in_other_groups(make_shop):
    shop = make_shop(
        costs=[("p1", 4.0)], mapping=[("o1", "C001")], order_items=[("o1", None, 9.0), ("o1", "p1", 10.0)]
    )
    row = shop.campaign_roi.first()
    assert (row.revenue, row.gross_profit) == (19.0, 6.0)
    assert rows_of(kpis.top_products(tot.product_totals(shop.items, shop.costs))) == [("p1", 6.0)]
    assert rows_of(features.product_costs(shop.items).select("product_id")) == [("p1",)]


def test_order_without_mapping_has_no_campaign(make_shop):
    shop = make_shop(
        costs=[("p1", 4.0)], mapping=[("o1", "C001")], order_items=[("o1", "p1", 10.0), ("o2", "p1", 10.0)]
    )
    assert [(r.campaign_id, r.revenue) for r in shop.campaign_roi.collect()] == [("C001", 10.0)]


CATEGORY_TABLES = dict(
    products=[("p1", "kn1"), ("p2", "kn2"), ("p3", None), ("p4", "untranslated")],
    category_translation=[("kn1", "toys"), ("kn2", "books")],
    costs=[(p, 1.0) for p in ["p1", "p2", "p3", "p4", "p5"]],
    order_items=[("o1", p, 10.0) for p in ["p1", "p2", "p3", "p4", "p5"]],
)


def test_unknown_categories(make_shop):
    shop = make_shop(**CATEGORY_TABLES)
    assert rows_of(categories.top_categories_by_revenue(shop.category_totals)) == [("books", 10.0), ("toys", 10.0)]
    kept = {r.category: r.revenue for r in categories.category_sums(shop.category_totals_with_unknown).collect()}
    assert kept == {"toys": 10.0, "books": 10.0, "unknown": 30.0}
    assert {r.category for r in categories.category_performance(shop.category_totals_with_unknown).collect()} == {"toys", "books"}


def test_ties_go_to_the_smaller_key(make_shop):
    shop = make_shop(**CATEGORY_TABLES)
    assert categories.top_category_by_profit(shop.category_totals).first().category == "books"
    insight = categories.marketing_insights(shop.category_totals).first()
    assert (insight.top_revenue_category, insight.top_profit_category) == ("books", "books")
    assert [r.product_id for r in kpis.top_products(shop.product_totals, 2).collect()] == sorted(
        r.product_id for r in kpis.top_products(shop.product_totals, 2).collect()
    )


@pytest.mark.parametrize(
    "average, segment",
    [(170.0, "Premium"), (169.99, "High Value"), (100.0, "High Value"), (99.99, "Regular"), (50.0, "Regular"), (49.99, "Occasional")],
)
def test_segment_edges(make_shop, average, segment):
    shop = make_shop(
        order_items=[("o1", "p1", average - 10), ("o1", "p2", average + 10)],
        orders=[("o1", "c1", None)],
        customers=[("c1", "u1"), ("idle", "u2")],
    )
    found = {r.customer_id: r.customer_segment for r in shop.segments.collect()}
    assert found == {"c1": segment, "idle": "Occasional"}


def totals_frame(spark, rows):
    """Category totals from (category, revenue, profit, mean margin)."""
    return spark.createDataFrame(
        [(c, 1, 1, 1, int(r * 100), 0, int(p * 100), 1, float(m)) for c, r, p, m in rows],
        "category string, items long, priced long, costed long, revenue_cents long, cost_cents long, "
        "profit_cents long, margin_rows long, margin_sum double",
    )


def test_benchmark_rules(spark):
    totals = totals_frame(spark, [("a", 100, 50, 1), ("b", 100, 5, 1), ("c", 10, 5, 1), ("d", 10, 50, 1)])
    strict = {r.category: r.recommendation for r in categories.promotion_recommendations(totals).collect()}
    assert strict == {
        "a": "Increase promotion budget",
        "b": "Reduce discounts and improve margins",
        "c": "Review category strategy",
        "d": "Test targeted promotions",
    }
    loose = {r.category: r.what_to_do for r in categories.strategy_advice(totals).collect()}
    assert loose == {"a": ADS, "b": FEWER_DISCOUNTS, "c": STOP, "d": SMALL_DISCOUNTS}
    assert [r.category for r in categories.strategy_advice(totals, STOP).collect()] == ["c"]


def test_benchmark_equality(spark):
    totals = totals_frame(spark, [("a", 10.1, 5.3, 1), ("b", 10.1, 5.3, 1), ("c", 10.1, 5.3, 1)])
    assert {r.recommendation for r in categories.promotion_recommendations(totals).collect()} == {"Test targeted promotions"}
    assert {r.what_to_do for r in categories.strategy_advice(totals).collect()} == {STOP}


def test_margin_advice(spark):
    totals = totals_frame(spark, [("a", 1, 1, 19.9), ("b", 1, 1, 20), ("c", 1, 1, 40), ("d", 1, 1, 40.1)])
    advice = {r.category: r.advice for r in categories.category_margin_advice(totals).collect()}
    assert advice == {"a": "stop discounts", "b": "hold prices", "c": "hold prices", "d": "small discount"}


def test_margin_of_raw_items_meets_the_limits_exactly(make_shop):
    tables = dict(products=[("p1", "k")], category_translation=[("k", "toys")])
    for cost, advice in [(80.0, "hold prices"), (60.0, "hold prices"), (80.01, "stop discounts"), (59.99, "small discount")]:
        shop = make_shop(costs=[("p1", cost)], order_items=[("o", "p1", 100.0)] * 3, **tables)
        assert categories.category_margin_advice(shop.category_totals).first().advice == advice


def test_campaign_verdicts(make_shop):
    shop = make_shop(
        costs=[("p1", 0.0)],
        mapping=[("o1", "C001"), ("o2", "C002")],
        order_items=[("o1", "p1", 6000.0), ("o2", "p1", 4000.0)],
    )
    verdicts = {r.place: (r.campaign_name, r.verdict) for r in campaigns.campaign_verdict(shop.campaign_roi).collect()}
    assert verdicts == {"best": ("New Year Sale", "repeat"), "worst": ("Summer Sale", "stop")}
    kpi = campaigns.campaign_kpis(shop.campaign_roi).first()
    assert (kpi.best_roi_pct, kpi.worst_roi_pct, kpi.total_budget) == (20.0, -50.0, 13000)
    assert campaigns.campaign_kpis(shop.campaign_roi).first().max_profit_campaign == "New Year Sale"


def test_worst_campaign_above_zero_is_watched(make_shop):
    shop = make_shop(costs=[("p1", 0.0)], mapping=[("o1", "C005")], order_items=[("o1", "p1", 6000.0)])
    assert {r.verdict for r in campaigns.campaign_verdict(shop.campaign_roi).collect()} == {"repeat", "watch"}


def test_campaign_without_budget_has_no_return(make_shop):
    shop = make_shop(
        costs=[("p1", 1.0)],
        mapping=[("o1", "A"), ("o2", "B")],
        order_items=[("o1", "p1", 6.0), ("o2", "p1", 4.0)],
        campaigns=[("A", "a", "x", 5, 0), ("B", "b", "x", 5, 2)],
    )
    roi = {r.campaign_id: r.roi_pct for r in shop.campaign_roi.collect()}
    assert roi == {"A": None, "B": 50.0}
    kpi = campaigns.campaign_kpis(shop.campaign_roi).first()
    assert (kpi.best_campaign, kpi.worst_campaign, kpi.max_profit_campaign) == ("b", "b", "a")
    assert rows_of(campaigns.channel_roi(shop.campaign_roi)) == [("x", 8.0, 2, 300.0)]


def test_missing_discount_gives_null_change(make_shop):
    shop = make_shop(costs=[("p1", 0.0)], mapping=[("o1", "C001")], order_items=[("o1", "p1", 6.0)])
    assert rows_of(pricing.discount_volume_change(shop.discount_performance)) == [(None, None, None)]
    assert rows_of(pricing.discount_volume_change(shop.discount_performance, 10, 10)) == [(1, 1, 0.0)]
    assert pricing.discount_labels(shop.discount_performance).first().discount == "10%"


def base_frame(spark, units):
    return spark.createDataFrame([("toys", "All Customers", units, 10.0, 4.0)], "category string, segment string, base_units long, avg_price double, avg_cost double")


def test_forecast_units_round_half_even_and_are_at_least_one(spark):
    row = forecast.promotion_forecast(base_frame(spark, 50), discounts=(5,), budgets=(1000,)).first()
    assert row.units == 2 and row.revenue == 2 * 9.5 and row.cost == 8.0 and row.profit == 11.0
    assert row.roi_pct == (11.0 - 1000) / 1000 * 100
    assert forecast.promotion_forecast(base_frame(spark, 1), discounts=(5,), budgets=(1000,)).first().units == 1
    odd = forecast.promotion_forecast(base_frame(spark, 1000), discounts=(7,), budgets=(1000,)).first()
    assert odd.units == 50
    assert forecast.profit_curve(base_frame(spark, 50)).count() == 5


def test_forecast_verdicts(spark):
    rows = spark.createDataFrame(
        [("a", "s", 10, 5, -1.0, 9.0, 30.0), ("b", "s", 10, 5, 100.0, 20.0, 31.0), ("c", "s", 10, 5, 100.1, 21.0, 30.1), ("d", "s", 10, 5, 0.0, 10.0, 0.0)],
        "category string, segment string, budget int, discount_pct int, roi_pct double, profit double, margin_pct double",
    )
    out = {r.category: (r.verdict, r.profit_up, r.margin_up, r.roi_up) for r in forecast.forecast_verdict(rows).collect()}
    assert out == {
        "a": ("losing", False, False, False),
        "b": ("moderate", True, True, True),
        "c": ("excellent", True, True, True),
        "d": ("moderate", False, False, False),
    }


def test_forecast_falls_back_to_the_category(make_shop):
    shop = make_shop(
        costs=[("p1", 4.0), ("p2", 2.0)],
        segments=[("c1", "u1", "Premium"), ("c2", "u2", "odd label")],
        order_items=[("o1", "p1", 10.0), ("o2", "p1", 20.0), ("o2", "p2", 6.0)],
        orders=[("o1", "c1", None), ("o2", "c2", None)],
        products=[("p1", "k"), ("p2", "k")],
        category_translation=[("k", "toys")],
    )
    base = {r.segment: (r.base_units, r.avg_price, r.avg_cost) for r in shop.forecast_base.collect()}
    whole = (3, 12.0, 10.0 / 3)
    assert base["Big Spenders"] == (1, 10.0, 4.0)
    for segment in ["All Customers", "Frequent Shoppers", "Normal Shoppers", "Rare Shoppers"]:
        assert base[segment] == pytest.approx(whole)


def test_segment_reports(make_shop):
    shop = make_shop(
        costs=[("p1", 4.0)],
        segments=[("c1", "u1", "Premium"), ("c2", "u2", "Regular")],
        order_items=[("o1", "p1", 10.0), ("o1", "p1", 10.0), ("o2", "p1", 30.0), ("lost", "p1", 1.0)],
        orders=[("o1", "c1", None), ("o2", "c2", None), ("empty", "c2", None)],
        products=[("p1", None)],
    )
    summary = {r.segment: r for r in shop.segment_summary(True).collect()}
    assert (summary["Big Spenders"].total_orders, summary["Big Spenders"].aov) == (1, 20.0)
    assert (summary["Normal Shoppers"].total_orders, summary["Normal Shoppers"].aov) == (1, 30.0)
    best = segments.best_segment(segments.segment_profitability(shop.segment_totals("left"))).first()
    assert (best.customer_segment, best.gross_profit) == ("Regular", 26.0)
    top = segments.segment_top_categories(shop.segment_product_totals, shop.products_tr).collect()
    assert {(r.customer_segment, r.category, r.items) for r in top} == {("Big Spenders", "unknown", 2), ("Normal Shoppers", "unknown", 1)}
    assert all(r.treatment for r in segments.segment_advice(shop.segment_summary(True)).collect())


@pytest.mark.parametrize("margin, health", [(39.99, "low"), (40.0, "good")])
def test_margin_health(spark, margin, health):
    totals = totals_frame(spark, [("a", 100, margin, 1)])
    assert kpis.margin_health(totals).first().health == health


def test_quadrants(spark):
    totals = totals_frame(spark, [("a", 1, 1, 10), ("b", 2, 1, 20), ("c", 3, 1, 60)])
    found = {r.category: r.quadrant for r in categories.category_benchmarks(categories.category_performance(totals)).collect()}
    assert found == {"a": "low sales, low share", "b": "high sales, low share", "c": "high sales, high share"}


def test_month_range_is_closed(make_shop):
    import datetime as dt

    days = [dt.datetime(2016, 12, 31, 23, 59), dt.datetime(2017, 1, 1), dt.datetime(2018, 8, 31, 23, 59, 59), dt.datetime(2018, 9, 1)]
    shop = make_shop(
        costs=[("p1", 1.0)],
        order_items=[(f"o{i}", "p1", 10.0) for i in range(4)],
        orders=[(f"o{i}", "c", day) for i, day in enumerate(days)],
    )
    trend = kpis.monthly_trend(shop.items, shop.orders, "2017-01", "2018-08", shop.costs)
    assert rows_of(trend) == [("2017-01", 10.0, 9.0), ("2018-08", 10.0, 9.0)]


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [1.0, 1.0, 1.0, 9999999.99], [-3.5, 0.0, 655.36, 655.35, 12000.0, 7.25], [float(i % 977) * 13.37 for i in range(4000)]])
def test_quantiles_match_pandas(spark, values):
    import pandas as pd

    series = pd.Series([round(v, 2) for v in values])
    df = spark.createDataFrame([(float(v), None) for v in series] + [(None, 1.0)], "x double, y double").repartition(5)
    got = {r.metric: r for r in statistics.describe(df, ["x", "y"]).collect()}
    want = series.describe()
    row = got["x"]
    assert row["count"] == want["count"] and row["min"] == want["min"] and row["max"] == want["max"]
    assert (row.mean, row.q25, row.q50, row.q75) == pytest.approx((want["mean"], want["25%"], want["50%"], want["75%"]), abs=1e-5)
    if len(values) > 1:
        assert row["std"] == pytest.approx(want["std"], rel=1e-9, abs=1e-6)
    assert got["y"]["count"] == 1 and got["y"]["std"] is None
    assert statistics.median(df, "x").first()[0] == pytest.approx(series.median(), abs=1e-6)


def test_generic_grouping_drops_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("a", None), ("b", None)], "k string, v double")
    out = rows_of(relational.group_agg(df, "k", sums={"s": "v"}, means={"m": "v"}, counts={"n": "v"}).orderBy("k"))
    assert out == [("a", 2.0, 2.0, 1), ("b", 0.0, None, 0)]
    assert rows_of(relational.top_k(df.filter("v is not null"), "v", 1, "k")) == [("a", 2.0)]
    assert rows_of(relational.value_counts(df, "k")) == [("a", 2), ("b", 1)]
    assert relational.filter_opt(df, "k").count() == 4 and relational.filter_opt(df, "k", "a").count() == 2
    assert rows_of(relational.distinct_values(relational.fill_unknown(df, "k"), "k")) == [("a",), ("b",)]
    assert relational.n_distinct(df, "k", approximate=True).first()[0] == 2
    assert relational.arg_max(df, "k", "v").first().k == "a"


@pytest.mark.parametrize("values", [[1234567.891] * 9, [98765432.10, 98765432.11], [round(0.001 * (i % 10), 3) for i in range(500)], [10.0**k * (-1) ** k for k in range(-3, 9)], [float("nan"), 1.5, 2.125]])
def test_statistics_of_fine_wide_and_constant_values(spark, values):
    import pandas as pd

    series = pd.Series(values)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    row, want = statistics.describe(df, ["x"], digits=3).first(), series.describe()
    assert (row["count"], row["min"], row["max"]) == (want["count"], want["min"], want["max"])
    assert (row["mean"], row.q25, row.q50, row.q75) == pytest.approx((want["mean"], want["25%"], want["50%"], want["75%"]), rel=1e-12)
    assert row["std"] == pytest.approx(want["std"], rel=1e-6, abs=1e-9)
    if len(set(values)) == 1:
        assert row["std"] == 0.0
    assert statistics.median(df, "x", digits=3).first()[0] == pytest.approx(series.median())


def test_finer_values_are_errors_and_generic_sums_keep_them(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([("a", 0.001 * (i % 10)) for i in range(1000)], "k string, v double")
    assert relational.total(df, "v").first()[0] == pytest.approx(4.5)
    assert relational.total(df, "v", digits=3).first()[0] == 4.5
    assert relational.mean(df, "v").first()[0] == pytest.approx(0.0045, rel=1e-12)
    assert relational.group_sum(df, "k", "v").first().v == pytest.approx(4.5)
    assert relational.benchmark(df, "v").first()[0] == pytest.approx(0.0045)
    for call in (lambda: relational.total(df, "v", digits=2), lambda: statistics.median(df, "v"), lambda: relational.total(spark.sql("SELECT double('NaN') AS v"), "v", digits=2)):
        with pytest.raises(PySparkException):
            call().collect()


def test_no_window_of_the_quantiles_sees_all_ranges(spark):
    df = spark.range(200_000).selectExpr("id * 5000000.0D AS x")  # every value in a range of its own
    frame = statistics.exact_quantiles(df, ["x"])
    assert rows_of(frame) == [("x", 49999 * 5e6 + 0.75 * 5e6, 99999.5 * 5e6, 149999.25 * 5e6)]
    counts = statistics._ranges(statistics._values(df, ["x"], 2))
    for shift in (32, 16):
        assert counts.select(F.shiftright("range", shift)).distinct().count() <= 65_536


def test_mean_margins_do_not_depend_on_the_order_of_rows(spark):
    from marginmill.operators import totals

    items = [(f"p{i % 7}", round(0.37 + (i * 7919 % 10007) / 3.1, 2)) for i in range(3000)]
    costs = spark.createDataFrame([(f"p{i}", 1.0 + i) for i in range(7)], "product_id string, cost_price double")
    found = set()
    for parts in (1, 7, 64):
        df = spark.createDataFrame(items, "product_id string, price double").orderBy(F.rand(parts)).repartition(parts)
        row = totals.roll_up(totals.product_totals(df, costs)).select("margin_sum", (F.col("margin_sum") / F.col("margin_rows")).alias("mean")).first()
        found.add((row.margin_sum, row["mean"]))
    assert len(found) == 1
