"""The logical tables of one shop and the frames derived from them. Everything is lazy; nothing is stored here."""

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import CAMPAIGN_IDS, SEGMENT_THRESHOLDS
from ..operators import campaigns, categories, distinct, features, forecast, joins, pricing, segments, totals
from ..schemas import RAW_TABLES
from ..sources import tables


@dataclass
class Shop:
    """`table` opens a logical table by name when a report first needs it."""

    table: Callable[[str], DataFrame]
    thresholds: list = field(default_factory=lambda: SEGMENT_THRESHOLDS)
    months: tuple = ("2017-01", "2018-08")
    # Whether the shop has campaigns of its own instead of the built-in ones.
    own_campaigns: bool = False
    # Tables a feature job has written; what is missing is derived on the fly.
    stored_costs: DataFrame | None = None
    stored_mapping: DataFrame | None = None
    stored_segments: DataFrame | None = None
    stored_sales: DataFrame | None = None
    # Orders and mapping as they lie beside a laid-out fact (`layout.py`): a row for each part of a heavy order.
    laid_orders: DataFrame | None = None
    laid_mapping: DataFrame | None = None

    items = cached_property(lambda self: self.table("order_items"))
    orders = cached_property(lambda self: self.table("orders"))
    customers = cached_property(lambda self: self.table("customers"))
    products = cached_property(lambda self: self.table("products"))
    payments = cached_property(lambda self: self.table("payments"))
    translation = cached_property(lambda self: self.table("category_translation"))
    campaigns = cached_property(lambda self: self.table("campaigns"))
    turns = cached_property(lambda self: self.table("turns"))

    @cached_property
    def questions(self) -> DataFrame:
        """The turns of users."""
        return self.turns.filter(F.col("role") == "user").drop("role")

    @cached_property
    def fact(self) -> DataFrame:
        return self.items if self.stored_sales is None else self.stored_sales

    @cached_property
    def costs(self) -> DataFrame:
        return features.product_costs(self.items) if self.stored_costs is None else self.stored_costs

    @cached_property
    def fact_costs(self) -> DataFrame | None:
        """The cost table the fact still needs: none where the stored fact has cost on its rows."""
        return self.costs if self.stored_sales is None else None

    @cached_property
    def mapping(self) -> DataFrame:
        if self.stored_mapping is not None:
            return self.stored_mapping
        return features.campaign_mapping(self.orders, self.campaign_ids)

    @cached_property
    def fact_orders(self) -> DataFrame:
        """The orders that the fact is joined to."""
        return self.orders if self.laid_orders is None else self.laid_orders

    @cached_property
    def fact_mapping(self) -> DataFrame:
        """The mapping that the fact is joined to."""
        return self.mapping if self.laid_mapping is None else self.laid_mapping

    @property
    def campaign_ids(self):
        """The ids a mapping draws from, in order: of a shop's own campaigns one row that a subquery reads."""
        if not self.own_campaigns:
            return CAMPAIGN_IDS
        return self.campaigns.agg(F.sort_array(F.collect_set("campaign_id")).alias("ids")).scalar()

    @cached_property
    def sales(self) -> DataFrame:
        if self.stored_sales is not None:
            return self.stored_sales.drop(*joins.LAYOUT)
        return features.sales_features(self.items, self.costs)

    def sales_with(self, *columns: str) -> DataFrame:
        """The sales fact of reports that use few of its columns: the hash that spreads heavy keys reads no others."""
        if self.stored_sales is not None:
            return self.stored_sales
        return features.sales_features(self.items.select("order_id", "product_id", "price", *columns), self.costs)

    @cached_property
    def segments(self) -> DataFrame:
        if self.stored_segments is not None:
            return self.stored_segments
        return features.customer_segments(self.items, self.orders, self.customers, self.thresholds, spend="price")

    @cached_property
    def products_tr(self) -> DataFrame:
        return joins.translate_products(self.products, self.translation)

    @cached_property
    def product_totals(self) -> DataFrame:
        if self.stored_sales is None and self.stored_costs is None:
            return totals.generated_product_totals(self.items)
        return totals.product_totals(self.fact, self.fact_costs)

    @cached_property
    def whole_totals(self) -> DataFrame:
        """Totals of everything sold, with distinct orders."""
        if self.stored_sales is None and self.stored_costs is None:
            return totals.generated_product_totals(self.items, with_orders=True)
        return totals.order_totals(self.fact, self.fact_costs)

    @cached_property
    def campaign_order_totals(self) -> DataFrame:
        return campaigns.campaign_order_totals(self.fact, self.fact_mapping, self.fact_costs)

    @cached_property
    def ordered_product_totals(self) -> DataFrame:
        """Totals per product of the items whose order exists."""
        return totals.product_totals(joins.with_orders(self.fact, self.fact_orders, cols=()), self.fact_costs)

    @cached_property
    def ordered_category_totals(self) -> DataFrame:
        return categories.category_totals(self.ordered_product_totals, self.products_tr)

    @cached_property
    def customer_category_totals(self) -> DataFrame:
        """Totals per category of the items whose order and customer exist."""
        known = self.fact_orders.join(self.customers.select("customer_id"), "customer_id")
        by_product = totals.product_totals(joins.with_orders(self.fact, known, cols=()), self.fact_costs)
        return categories.category_totals(by_product, self.products_tr)

    @cached_property
    def category_totals(self) -> DataFrame:
        return categories.category_totals(self.product_totals, self.products_tr)

    @cached_property
    def category_totals_with_unknown(self) -> DataFrame:
        return categories.category_totals(self.product_totals, self.products_tr, "keep")

    @cached_property
    def campaign_product_totals(self) -> DataFrame:
        return campaigns.campaign_product_totals(self.fact, self.fact_mapping, self.fact_costs)

    @cached_property
    def campaign_totals(self) -> DataFrame:
        return campaigns.campaign_totals(self.fact, self.fact_mapping, self.fact_costs)

    @cached_property
    def campaign_roi(self) -> DataFrame:
        return campaigns.campaign_roi(self.campaign_totals, self.campaigns)

    @cached_property
    def discount_totals(self) -> DataFrame:
        return pricing.discount_totals(self.campaign_totals, self.campaigns)

    @cached_property
    def discount_performance(self) -> DataFrame:
        return pricing.discount_performance(self.discount_totals)

    def order_segments(self, how: str = "inner", plain_names: bool = False) -> DataFrame:
        return joins.order_segments(self.fact_orders, self.segments, how, plain_names)

    def segment_totals(self, how: str = "inner", plain_names: bool = False) -> DataFrame:
        return segments.segment_totals(self.fact, self.order_segments(how, plain_names), self.fact_costs, how)

    @cached_property
    def segment_product_totals(self) -> DataFrame:
        return segments.segment_product_totals(self.fact, self.order_segments("inner", True), self.fact_costs)

    def segment_summary(self, plain_names: bool) -> DataFrame:
        order_segments = self.order_segments("inner", plain_names)
        return segments.segment_summary(segments.segment_order_totals(self.fact, order_segments, self.fact_costs))

    @cached_property
    def category_segment_totals(self) -> DataFrame:
        return forecast.category_segment_totals(self.segment_product_totals, self.products_tr)

    @cached_property
    def forecast_base(self) -> DataFrame:
        return forecast.base_stats(self.category_segment_totals)

    @cached_property
    def sales_keys(self) -> DataFrame:
        return distinct.sales_keys(self.fact, self.fact_orders, self.fact_mapping)

    @cached_property
    def reach_sketches(self) -> DataFrame:
        """Sketches of the distinct orders, products and customers of each month and campaign."""
        return distinct.sketches(self.sales_keys, distinct.KEYS, distinct.COUNTED)

    @cached_property
    def wide(self) -> DataFrame:
        return joins.sales_wide(
            self.fact,
            self.fact_costs,
            self.fact_orders,
            self.segments,
            self.products_tr,
            self.fact_mapping,
            self.campaigns,
        )

    def raw_tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in RAW_TABLES}


def load_shop(spark: SparkSession, directory: str, fmt: str = "parquet", **options) -> Shop:
    """A directory with one file per raw table plus category_translation, and campaigns; without these the built-in ones."""
    own = tables.exists(spark, "campaigns", directory, fmt)

    def table(name):
        if name == "campaigns" and not own:
            return tables.campaigns(spark)
        return tables.read_table(spark, name, directory, fmt)

    return Shop(table, own_campaigns=own, **options)


FEATURES = ["product_costs", "campaigns", "campaign_sales_mapping", "sales_features", "customer_segments"]


def write_features(spark: SparkSession, shop: Shop, directory: str, fmt: str = "parquet") -> Shop:
    """The feature jobs: write costs, campaigns, mapping, sales fact and segments, each one full overwrite. Costs are
    written first and read back for the fact: of a stored table Spark knows the size, so it can broadcast a small one
    instead of shuffling the fact to it. Returns the shop on its stored tables."""

    def write(name, df):
        tables.write_table(df, f"{directory.rstrip('/')}/{name}.{fmt}", fmt)
        return tables.read_table(spark, name, directory, fmt)

    shop = replace(shop, stored_costs=write("product_costs", shop.costs))
    write("campaigns", shop.campaigns)
    mapping = write("campaign_sales_mapping", shop.mapping)
    sales = write("sales_features", shop.sales)
    segments_ = write("customer_segments", shop.segments)
    return replace(shop, stored_mapping=mapping, stored_sales=sales, stored_segments=segments_)


def with_stored_features(spark: SparkSession, shop: Shop, directory: str, fmt: str = "parquet") -> Shop:
    """The same shop reading the tables the feature jobs have written: reports then join no cost to the fact."""

    def stored(name):
        return tables.read_table(spark, name, directory, fmt)

    return replace(
        shop,
        stored_costs=stored("product_costs"),
        stored_mapping=stored("campaign_sales_mapping"),
        stored_segments=stored("customer_segments"),
        stored_sales=stored("sales_features"),
    )


# The totals that most reports start from, as small as products, categories, campaigns and months.
REMEMBERED = [
    "product_totals", "ordered_product_totals", "customer_category_totals", "category_segment_totals", "campaign_totals",
    "reach_sketches",
]


def with_remembered_totals(spark: SparkSession, shop: Shop, directory: str) -> Shop:
    """The same shop on stored totals, which are worked out again only where a file of the shop has changed: a second
    session reads no sold item for these reports."""
    sources = [*shop.raw_tables().values(), shop.translation, shop.campaigns]
    stored = [shop.stored_costs, shop.stored_mapping, shop.stored_segments, shop.stored_sales]
    sources += [df for df in stored if df is not None]
    settings = repr((shop.thresholds, shop.own_campaigns, [df is not None for df in stored]))
    again = replace(shop)
    for name in REMEMBERED:
        table = tables.remembered(getattr(shop, name), f"{directory.rstrip('/')}/{name}.parquet", sources, settings)
        setattr(again, name, table)
    return again


# The star-schema test tables seen as a shop: a line is a sold item, a brand is a category. Each logical table is a
# file, its columns (a declared schema spares the job that would look it up), and their names here. All columns of a file are
# carried along, and scans read those a query uses; a payment is an order's total.
STAR_TABLES = {
    "order_items": ("lineitem", {
        "l_orderkey bigint": "order_id",
        "l_partkey bigint": "product_id",
        "l_linenumber int": "item_no",
        "l_extendedprice double": "price",
        "l_suppkey bigint": "supplier_id",
        "l_quantity double": "quantity",
        "l_discount double": "discount",
        "l_tax double": "tax",
        "l_returnflag string": "return_flag",
        "l_linestatus string": "line_status",
        "l_shipdate timestamp_ntz": "ship_date",
    }),
    "orders": ("orders", {
        "o_orderkey bigint": "order_id",
        "o_custkey bigint": "customer_id",
        "o_orderdate timestamp_ntz": "order_purchase_timestamp",
        "o_orderstatus string": "order_status",
        "o_totalprice double": "total_price",
        "o_orderpriority string": "order_priority",
    }),
    "payments": ("orders", {"o_orderkey bigint": "order_id", "o_totalprice double": "payment_value"}),
    "customers": ("customer", {
        "c_custkey bigint": "customer_id",
        "c_name string": "customer_unique_id",
        "c_nationkey int": "nation_id",
        "c_acctbal double": "account_balance",
        "c_mktsegment string": "market_segment",
    }),
    "products": ("part", {
        "p_partkey bigint": "product_id",
        "p_brand string": "product_category_name",
        "p_name string": "product_name",
        "p_type string": "product_type",
        "p_size int": "product_size",
        "p_retailprice double": "retail_price",
    }),
    "turns": ("conversations", {
        "conv_id bigint": "conv_id", "turn bigint": "turn", "role string": "role", "text string": "text",
    }),
}

# Brands with a translated category; the remaining brands stay without one.
TRANSLATED_BRANDS = range(1, 24)


def bind_star_schema(spark: SparkSession, directory: str) -> Shop:
    def table(name):
        if name == "campaigns":
            return tables.campaigns(spark)
        if name == "category_translation":
            pairs = ", ".join(f"('Brand#{n}', 'category_{n}')" for n in TRANSLATED_BRANDS)
            return spark.sql(
                f"SELECT * FROM VALUES {pairs} AS t(product_category_name, product_category_name_english)"
            )
        file, columns = STAR_TABLES[name]
        raw = spark.read.schema(", ".join(columns)).parquet(f"{directory.rstrip('/')}/{file}.parquet")
        return raw.toDF(*columns.values())

    return Shop(
        table,
        thresholds=[(57000.0, "Premium"), (53000.0, "High Value"), (49000.0, "Regular")],
        months=("1996-01", "1999-12"),
    )
