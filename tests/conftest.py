import pytest
from pyspark.sql import SparkSession

from marginmill.plans.shop import Shop
from marginmill.sources import tables


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SCHEMAS = {
    "order_items": "order_id string, product_id string, price double",
    "orders": "order_id string, customer_id string, order_purchase_timestamp timestamp_ntz",
    "customers": "customer_id string, customer_unique_id string",
    "products": "product_id string, product_category_name string",
    "payments": "order_id string, payment_value double",
    "category_translation": "product_category_name string, product_category_name_english string",
    "campaigns": "campaign_id string, campaign_name string, channel string, discount_pct int, budget int",
    "questions": "conv_id bigint, turn bigint, text string",
    "product_costs": "product_id string, cost_price double",
    "campaign_sales_mapping": "order_id string, campaign_id string",
    "customer_segments": "customer_id string, customer_unique_id string, customer_segment string",
}


@pytest.fixture
def frame(spark):
    """Rows of a logical table as a DataFrame."""
    return lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])


@pytest.fixture
def make_shop(spark, frame):
    """A shop from rows per table; costs, mapping and segments may be given or left to be derived."""

    def build(costs=None, mapping=None, segments=None, **rows):
        def table(name):
            if name == "campaigns" and name not in rows:
                return tables.campaigns(spark)
            return frame(name, rows.get(name, []))

        return Shop(
            table,
            stored_costs=None if costs is None else frame("product_costs", costs),
            stored_mapping=None if mapping is None else frame("campaign_sales_mapping", mapping),
            stored_segments=None if segments is None else frame("customer_segments", segments),
        )

    return build


def rows_of(df):
    return [tuple(r) for r in df.collect()]
