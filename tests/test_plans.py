"""The plans Spark makes for the registered queries, with every join too large to broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from marginmill.functions.columns import draw_choice
from marginmill.operators.campaigns import campaign_totals
from marginmill.operators.features import customer_segments, product_costs, sales_features
from marginmill.operators.joins import order_segments, sales_wide
from marginmill.operators.relational import heavy_keys, spread_join
from marginmill.plans.catalogue import RELATIONS, REPORTS, registered
from marginmill.plans.shop import bind_star_schema, write_features
from marginmill.sources import tables

DIRECTORY = "/root/testdata/sf0.001"
QUERIES = registered()


@pytest.fixture
def large(spark):
    """No join side counts as small, neither by estimate nor by measurement."""
    settings = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {s: spark.conf.get(s, None) for s in settings}
    for s in settings:
        spark.conf.set(s, "-1")
    yield spark
    for s, value in old.items():
        spark.conf.unset(s) if value is None else spark.conf.set(s, value)


def plan_of(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    return plan_of(df, run=True).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_no_product_no_hidden_broadcast(large, name):
    plan = plan_of(QUERIES[name](large, DIRECTORY))
    # The aggregates on objects are sketches, whose size is fixed: of heavy keys, and of distinct values by month and campaign.
    plan = re.sub(r"ObjectHashAggregate\(keys=\[\], functions=\[(partial_)?approx_top_k", "", plan)
    plan = re.sub(r"ObjectHashAggregate\(keys=\[[^]]*\], functions=\[(partial_)?(merge_)?hll_(sketch|union)_agg", "", plan)
    for bad in ["Python", "CartesianProduct", "BroadcastNestedLoopJoin", "ObjectHashAggregate"]:
        assert bad not in plan, bad
    # Broadcast hints are on the hit ranges of the quantiles and one row for each metric, whose numbers are fixed.
    if name not in ("q07_sales_stats", "a11_median", "a15_describe"):
        assert "BroadcastExchange" not in plan


# Results at the grain of a table, which carry all of its columns along.
WHOLE_ROWS = {
    "q06_sales_features", "s1_read_items", "s2_preview", "j2_sales_campaign_id", "j3_sales_campaign", "j4_sales_category",
    "j6_sales_orders_inner", "j7_sales_orders_left", "j8_sales_segment_inner", "j9_sales_segment_left", "j13_sales_wide",
    "p4_filter_and", "p9_rule", "p10_filter_optional", "p14_top1", "o4_top_k_per_group",
}


@pytest.mark.parametrize("name", sorted({*QUERIES} - WHOLE_ROWS - {"j10_customers_with_spend"}))
def test_scans_read_only_the_columns_used(spark, name):
    """Spark cuts a scan's long list of columns, which therefore has no end."""
    plan = plan_of(QUERIES[name](spark, DIRECTORY))
    for schema in re.findall(r"ReadSchema: struct<(.*)", plan):
        assert schema.endswith(">") and len(schema.split(",")) <= 4, schema


@pytest.mark.parametrize("name", sorted(WHOLE_ROWS))
def test_results_at_the_grain_of_the_item_carry_all_its_columns(spark, name):
    df = QUERIES[name](spark, DIRECTORY)
    file = spark.read.parquet(f"{DIRECTORY}/lineitem.parquet")
    items = bind_star_schema(spark, DIRECTORY).items
    assert len(items.columns) == len(file.columns)
    assert set(items.columns) <= set(df.columns)


def exchanges(plan, key):
    return len(re.findall(rf"(?<!Reused)Exchange hashpartitioning\({key}#\d+L?, ", plan))


def test_category_reports_shuffle_the_fact_once_and_join_no_cost(large):
    plan = final_plan(QUERIES["q20_category_performance"](large, DIRECTORY))
    assert plan.count("lineitem.parquet") == 1
    assert "order_id" not in plan


def test_campaign_report_joins_the_fact_once(large):
    plan = final_plan(QUERIES["q35_campaign_roi"](large, DIRECTORY))
    # Items and mapping meet on order_id; everything later is shuffled as totals.
    assert exchanges(plan, "order_id") == 2
    drawn = final_plan(QUERIES["q35_campaign_roi_drawn"](large, DIRECTORY))
    assert exchanges(drawn, "order_id") == 0


def test_segment_report_shuffles_the_sold_items_once(large):
    plan = final_plan(QUERIES["q30_segment_profitability"](large, DIRECTORY))
    raw_items = re.findall(r"Exchange hashpartitioning\(order_id#\d+L?, 8\).*\n(?:.*ColumnarToRow.*\n|.*Project.*l_extendedprice.*\n)", plan)
    assert len(raw_items) == 1


@pytest.mark.parametrize("name", ["q10_kpi_summary", "q11_executive_kpis", "q36_campaign_performance"])
def test_money_and_distinct_orders_come_from_one_read(large, name):
    """The costs of a product come from one more, where they are not those of the same totals."""
    plan = final_plan(QUERIES[name](large, DIRECTORY))
    assert plan.count("lineitem.parquet") == (1 if name == "q10_kpi_summary" else 2)


def test_stored_reports_read_the_fact_once(large, tmp_path):
    shop = bind_star_schema(large, DIRECTORY)
    stored = write_features(large, shop, str(tmp_path))
    for report in (REPORTS["q10_kpi_summary"], REPORTS["q11_executive_kpis"], REPORTS["q32_segment_summary"], REPORTS["q36_campaign_performance"]):
        assert len(re.findall(r"ReadSchema: struct<[^>]*gross_profit", final_plan(report(stored)))) == 1


def test_month_filter_reaches_the_scan(spark):
    plan = plan_of(QUERIES["q14_monthly_trend"](spark, DIRECTORY))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_month_range_reaches_the_scan(spark):
    plan = plan_of(QUERIES["p6_month_range"](spark, DIRECTORY))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def test_forecast_with_advice_starts_from_one_set_of_totals(large):
    """The advice reads nothing beyond what the forecast reads, and joins nothing to it."""
    alone, advised = (final_plan(QUERIES[n](large, DIRECTORY)) for n in ("q44_promotion_forecast", "q47_forecast_with_advice"))
    for part in ("lineitem.parquet", "orders.parquet", "SortMergeJoin"):
        assert advised.count(part) == alone.count(part) > 0


def test_top_k_never_sorts_everything(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["q12_top_products"](spark, DIRECTORY))
    for name in ["q25_top_products_in_category", "q33_segment_top_categories", "o4_top_k_per_group"]:
        plan = plan_of(QUERIES[name](spark, DIRECTORY))
        assert re.search(r"WindowGroupLimit .* Partial", plan), name


@pytest.fixture
def small_partitions(large):
    """Adaptive splitting at sizes that test data reaches."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "5KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    old = {s: large.conf.get(s) for s in settings}
    for s, value in settings.items():
        large.conf.set(s, value)
    yield large
    for s, value in old.items():
        large.conf.set(s, value)


N = 60000


def hot(column):
    """A third of the rows share one value."""
    return F.when(F.col("id") % 3 == 0, -1).otherwise(column)


def sold(spark, order_id, product_id):
    return spark.range(0, N, 1, 8).select(
        order_id.alias("order_id"), product_id.alias("product_id"), F.lit(2.0).alias("price")
    )


def test_a_hot_order_is_split(small_partitions):
    items = sold(small_partitions, hot(F.col("id")), F.col("id") % 1000)
    mapping = small_partitions.range(-1, N).select(F.col("id").alias("order_id"), draw_choice(F.col("id"), ["C001", "C001"]).alias("campaign_id"))
    costs = small_partitions.range(1000).select(F.col("id").alias("product_id"), F.lit(0.5).alias("cost_price"))
    df = campaign_totals(items, mapping, costs)
    assert "SortMergeJoin(skew=true)" in plan_of(df, run=True)
    row = df.first()
    assert (row["items"], row["revenue_cents"], row["profit_cents"]) == (N, N * 200, N * 150)


def test_a_hot_product_is_split(small_partitions):
    items = sold(small_partitions, F.col("id"), hot(F.col("id") % 1000))
    df = sales_features(items, product_costs(items))
    assert "SortMergeJoin(skew=true)" in plan_of(df, run=True)
    assert df.filter("cost_price is not null").count() == N


def largest_task(df):
    """Rows of the fullest partition of a result."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("segments_are", ["small", "large"])
def test_a_hot_order_of_the_wide_join_is_spread(small_partitions, segments_are):
    spark = small_partitions
    items = sold(spark, hot(F.col("id") % 5000), F.col("id") % 50)
    orders = spark.range(-1, 5000).select(F.col("id").alias("order_id"), F.col("id").alias("customer_id"))
    segments = spark.range(-1, 5000 if segments_are == "large" else 20).select(
        F.col("id").alias("customer_id"), F.lit("Premium").alias("customer_segment")
    )
    mapping = orders.select("order_id", F.lit("C001").alias("campaign_id"))
    costs = spark.range(50).select(F.col("id").alias("product_id"), F.lit(0.5).alias("cost_price"))
    products = spark.range(50).select(F.col("id").alias("product_id"), F.lit("x").alias("category"))
    wide = sales_wide(items, costs, orders, segments, products, mapping, tables.campaigns(spark))
    expected = items.join(segments, F.col("order_id") == F.col("customer_id")).count()
    assert wide.count() == expected
    # The hot order has 20,000 rows; spread over 64 tasks it is a few hundred in each.
    assert largest_task(wide) < 3000


def test_only_heavy_keys_are_repeated(small_partitions):
    spark = small_partitions
    even = spark.range(N).select((F.col("id") % 5000).alias("k"), "id")
    assert heavy_keys(even, "k").first()["keys"] == []
    keyed = spark.range(0, N, 1, 8).select(hot(F.col("id") % 5000).alias("k"), "id")
    nulls = keyed.unionByName(spark.range(N).select(F.lit(None).cast("long").alias("k"), "id"))
    assert heavy_keys(nulls, "k").first()["keys"] == [-1]
    table = spark.range(-1, 6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = spread_join(nulls, table, "k")
    assert joined.count() == 2 * N and joined.filter("k IS NOT NULL AND v IS DISTINCT FROM 2 * k").count() == 0
    assert largest_task(joined) < 4000
    text = keyed.withColumn("k", F.col("k").cast("string"))
    assert heavy_keys(text, "k").first()["keys"] == ["-1"] and heavy_keys(text.limit(0), "k").first()["keys"] == []
    # A table's row is repeated only where its key is heavy.
    copies = table.withColumn("n", F.when(F.array_contains(heavy_keys(keyed, "k").scalar(), F.col("k")), 16).otherwise(1))
    assert copies.agg(F.sum("n")).first()[0] == 6001 + 15


def test_a_hot_customer_is_split(small_partitions):
    orders = small_partitions.range(0, N, 1, 8).select(
        F.col("id").alias("order_id"), hot(F.col("id") % 5000).alias("customer_id")
    )
    customers = orders.select("customer_id", F.lit("u").alias("customer_unique_id")).distinct()
    items = orders.select("order_id", F.lit(1).alias("product_id"), F.lit(60.0).alias("price"))
    segments = customer_segments(items, orders, customers, spend="price")
    df = order_segments(orders, segments)
    assert "SortMergeJoin(skew=true)" in plan_of(df, run=True)
    assert [tuple(r) for r in df.groupBy("customer_segment").count().collect()] == [("Regular", N)]
