"""The shop on stored features and a laid-out fact: every report gives what its SQL gives on the raw tables."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marginmill.operators import joins, kpis
from marginmill.plans import catalogue, oracle
from marginmill.plans.layout import FACT, ORDERS, with_layout, write_layout
from marginmill.plans.shop import bind_star_schema, write_features
from marginmill.sources import tables

from .compare import differences, duck
from .conftest import rows_of

DIRECTORY = "/root/testdata/sf0.001"
BUCKETS = 4
ON_STORED = {**catalogue.REPORTS, "j13_sales_wide": catalogue.RELATIONS["j13_sales_wide"]}
#: Reports that join the fact by order. Distinct orders (Q11) are counted after the join, by a shuffle of one row per order and task.
BY_ORDER = ["q13_top_products_by_category", "q24_category_campaign", "q35_campaign_roi",
            "q36_campaign_performance", "q41_discount_performance"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    shop = write_features(spark, bind_star_schema(spark, DIRECTORY), str(folder / "features"))
    return shop, write_layout(spark, shop, str(folder / "layout"), BUCKETS)


@pytest.fixture
def large(spark):
    settings = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for s in settings:
        spark.conf.set(s, "-1")
    yield spark
    for s in settings:
        spark.conf.unset(s)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ON_STORED)
def test_report_on_the_laid_out_fact(stored, name):
    assert not differences(ON_STORED[name](stored[1]), duck(DIRECTORY), oracle.oracle_sql()[name])


@pytest.mark.parametrize("name", ["q06_sales_features", "q10_kpi_summary", "q14_monthly_trend", "q32_segment_summary", "q36_campaign_performance", "j13_sales_wide"])
def test_report_on_stored_features(stored, name):
    assert not differences(ON_STORED[name](stored[0]), duck(DIRECTORY), oracle.oracle_sql()[name])


@pytest.mark.parametrize("name", BY_ORDER)
def test_the_fact_is_not_shuffled_by_order(large, stored, name):
    plan = plan_of(ON_STORED[name](stored[1]))
    assert "SortMergeJoin" in plan and not re.search(r"Exchange hashpartitioning\((_order_part|order_id)", plan)
    # Without the layout it is.
    assert re.search(r"Exchange hashpartitioning\(order_id", plan_of(ON_STORED[name](stored[0])))


def test_item_joins_are_not_shuffled_by_order(large, stored):
    shop = stored[1]
    for joined in (joins.with_orders(shop.fact, shop.fact_orders), joins.with_orders(shop.fact, shop.fact_orders, "left"),
                   joins.with_campaign_id(shop.fact, shop.fact_mapping)):
        assert "SortMergeJoin" in plan_of(joined) and "Exchange" not in plan_of(joined)
        assert joined.count() == shop.items.count()


def test_a_report_over_months_reads_the_files_of_these_months(stored):
    shop = stored[1]
    one = kpis.monthly_trend(shop.fact, shop.fact_orders, "1997-03", "1997-03")
    assert "Join" not in plan_of(one) and re.search(r"PartitionFilters: \[.*_order_month", plan_of(one))
    scan = joins.in_months(shop.fact, shop.fact_orders, "1997-03", "1997-03").select(F.input_file_name().alias("file"))
    files = {r.file for r in scan.distinct().collect()}
    assert 0 < len(files) <= BUCKETS and all("_order_month=1997-03-01" in f for f in files)
    assert len(shop.fact.inputFiles()) > 10 * len(files)
    plain = kpis.monthly_trend(stored[0].fact, stored[0].orders, "1997-03", "1997-03")
    assert rows_of(one) == rows_of(plain) != []


def heavy_shop(make_shop):
    """One order with a third of all items, items without an order, and orders without a time."""
    items = [(f"o{n}", f"p{n % 7}", 1.0 + n % 5) for n in range(3000)] + [("hot", f"p{n % 7}", 2.0 + n) for n in range(1500)]
    orders = [(f"o{n}", f"c{n % 9}", None if n % 11 == 0 else f"2017-{n % 12 + 1:02}-05") for n in range(2990)]
    return make_shop(order_items=[*items, (None, "p1", 3.0)], orders=[], customers=[(f"c{n}", f"u{n}") for n in range(9)]), orders


def test_a_heavy_order_lies_in_all_buckets(spark, make_shop, frame, tmp_path):
    shop, orders = heavy_shop(make_shop)
    rows = spark.createDataFrame([*orders, ("hot", "c1", "2017-02-03")], "order_id string, customer_id string, t string")
    shop.orders = rows.select("order_id", "customer_id", F.to_timestamp_ntz("t").alias("order_purchase_timestamp"))
    laid = write_layout(spark, shop, str(tmp_path), BUCKETS)
    laid.orders = shop.orders
    hot = laid.fact.filter("order_id = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert laid.fact.filter("order_id = 'hot'").select(joins.ORDER_PART).distinct().count() == BUCKETS
    assert sum(r["count"] for r in hot) == 1500 and laid.laid_orders.filter("order_id = 'hot'").count() == BUCKETS
    assert laid.laid_orders.filter("order_id <> 'hot'").count() == len(orders)
    assert sorted(rows_of(laid.sales), key=str) == sorted(rows_of(shop.sales), key=str)
    for report in (
        lambda s: joins.with_orders(s.sales if s is shop else s.fact, s.fact_orders).drop(*joins.LAYOUT),
        lambda s: kpis.executive_kpis(s.fact, s.fact_orders, s.fact_costs),
        lambda s: kpis.monthly_trend(s.fact, s.fact_orders, "2017-01", "2017-06", s.fact_costs),
        lambda s: s.campaign_roi,
        lambda s: s.segment_summary(False),
    ):
        ours, plain = report(laid), report(shop)
        assert sorted(rows_of(ours.select(*plain.columns)), key=str) == sorted(rows_of(plain), key=str)


def test_a_lost_layout_leaves_the_one_before(spark, make_shop, frame, tmp_path):
    items = [("o1", "p1", 5.0), ("o2", "p2", 7.0)]
    orders = frame("orders", [("o1", "c1", None), ("o2", "c2", None)])
    directory = str(tmp_path)
    with pytest.raises(ValueError):
        with_layout(spark, make_shop(order_items=items), directory)
    shop = make_shop(order_items=items)
    shop.orders = orders
    write_layout(spark, shop, directory, 2)
    first = tables.current_version(spark, directory)
    lost = make_shop(order_items=items)
    lost.orders = orders
    lost.mapping = orders.select("order_id", F.raise_error(F.lit("lost")).cast("string").alias("campaign_id"))
    with pytest.raises(PySparkException):
        write_layout(spark, lost, directory, 2)
    assert tables.current_version(spark, directory) == first and with_layout(spark, shop, directory).fact.count() == 2
    write_layout(spark, shop, directory, 2)
    names = {r[0] for r in spark.sql(f"SHOW DATABASES LIKE '{first.rsplit('/', 1)[-1].rsplit('_', 1)[0]}*'").collect()}
    assert len(names) == 2 and first.rsplit("/", 1)[-1] in names


def test_empty_tables(spark, make_shop, tmp_path):
    shop = write_layout(spark, make_shop(), str(tmp_path), 2)
    assert {spark.table(f"{tables.current_version(spark, str(tmp_path)).rsplit('/', 1)[-1]}.{n}").count() for n in (FACT, ORDERS)} == {0}
    assert shop.campaign_totals.count() == 0
