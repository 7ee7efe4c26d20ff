"""Additive totals: the one shape every report is computed from.

Sold items are summed as soon as possible, by product and whatever else a report groups on, before anything is
shuffled. Cost is a property of the product, so it is joined to these totals and not to the items: the fact is
never shuffled on product_id, and a product with a third of all rows is one row per task by then. Money is
summed as whole cents and sums of sums as decimals, so no result depends on the order of the rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import COST_SHARE_LOW, COST_SHARE_WIDTH
from ..functions.columns import bround2, cents, draw_fraction, fixed_parts, from_fixed_parts, money, ratio_pct
from .relational import as_list, with_keys

#: Sums of row margins, exact at twelve decimals.
MARGIN_SUM = "decimal(38,12)"
#: Parts of the sum of 1 / price.
INVERSE = ["inverse_high", "inverse_middle", "inverse_low"]
TOTALS = ["items", "priced", "costed", "revenue_cents", "cost_cents", "profit_cents", "margin_rows"]


def item_totals(items: DataFrame, *keys: str, rows: Column | None = None) -> DataFrame:
    """Totals of raw items that carry no cost yet. Items without a product still belong to their other groups. `rows`: a
    column that is null in rows that are no items."""
    price = F.col("price")
    return items.groupBy(*keys).agg(
        F.count(F.lit(1) if rows is None else rows).alias("items"),
        F.count("price").alias("priced"),
        F.sum(cents(price)).alias("revenue_cents"),
        F.count_if(price != 0).alias("nonzero"),
        # Summed in fixed point, so that the mean margin does not depend on the order of the rows either.
        *[F.sum(part).alias(name) for name, part in zip(INVERSE, fixed_parts(F.try_divide(F.lit(1.0), price)))],
    )


def item_totals_with_orders(items: DataFrame, *keys: str) -> DataFrame:
    """item_totals by product and `keys`, with `orders`: the distinct orders with items of a group, counted at the rows
    without a product, as an order may have many. One pass: each item stands for itself and for its order; a task sends a product
    and an order once each, however many items they have."""
    none = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in ("product_id", "price", "order_id")]
    item = F.struct("product_id", "price", none[2], F.lit(1).alias("_item"))
    order = F.struct(none[0], none[1], "order_id", F.lit(None).cast("int").alias("_item"))
    both = items.select(*keys, F.inline(F.array(item, order)))
    first = item_totals(both, *keys, "product_id", "order_id", rows=F.col("_item"))
    sums = [F.sum(c).alias(c) for c in ("items", "priced", "revenue_cents", "nonzero", *INVERSE)]
    return first.groupBy(*keys, "product_id").agg(*sums, F.count("order_id").alias("orders"))


def generated_cost(mean_price: Column, product_id: Column) -> Column:
    """Mean price times a share drawn for the product."""
    return bround2(mean_price * draw_fraction(product_id, COST_SHARE_LOW, COST_SHARE_WIDTH))


def costs_of(product_totals: DataFrame) -> DataFrame:
    mean_price = F.try_divide(money(F.col("revenue_cents")), F.col("priced"))
    return product_totals.select("product_id", generated_cost(mean_price, F.col("product_id")).alias("cost_price"))


def _with_cost_measures(totals: DataFrame, keys) -> DataFrame:
    """`keys` are kept as they are. Spread the product's cost over its items. Mean row margin: 100 * (1 - cost / price), summed over rows."""
    cost = F.col("cost_price")
    unit = cents(cost)
    known = cost.isNotNull()
    return totals.select(
        *keys,
        "items",
        "priced",
        F.when(known, F.col("items")).otherwise(0).alias("costed"),
        F.coalesce("revenue_cents", F.lit(0)).alias("revenue_cents"),
        F.coalesce(F.col("items") * unit, F.lit(0)).alias("cost_cents"),
        F.coalesce(F.col("revenue_cents") - F.col("priced") * unit, F.lit(0)).alias("profit_cents"),
        F.when(known, F.col("nonzero")).otherwise(0).alias("margin_rows"),
        (F.lit(100.0) * (F.col("nonzero") - cost * from_fixed_parts(*map(F.col, INVERSE))))
        .cast(MARGIN_SUM)
        .alias("margin_sum"),
    )


def attach_costs(totals: DataFrame, costs: DataFrame, *keys: str) -> DataFrame:
    """Join the cost of each product to totals grouped by product_id and `keys`."""
    joined = totals.join(costs.select("product_id", "cost_price"), "product_id", "left")
    return _with_cost_measures(joined, ["product_id", *keys])


def generated_product_totals(items: DataFrame, with_orders: bool = False) -> DataFrame:
    """Totals per product with the generated cost, which follows from the same totals: one scan and no join. With orders
    there is a row without a product, which has them."""
    raw = item_totals_with_orders(items) if with_orders else item_totals(items, "product_id")
    mean_price = F.try_divide(money(F.col("revenue_cents")), F.col("priced"))
    return _with_cost_measures(
        raw.withColumn("cost_price", generated_cost(mean_price, F.col("product_id"))),
        ["product_id", "orders"] if with_orders else ["product_id"],
    )


def sales_totals(sales: DataFrame, *keys: str, with_orders: bool = False) -> DataFrame:
    """Totals of the stored sales fact, which has cost, profit and margin on every row; with the distinct `orders`, if
    asked for."""
    return sales.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.count("price").alias("priced"),
        F.count("cost_price").alias("costed"),
        *[
            F.coalesce(F.sum(cents(F.col(c))), F.lit(0)).alias(n)
            for n, c in [
                ("revenue_cents", "revenue"),
                ("cost_cents", "cost_price"),
                ("profit_cents", "gross_profit"),
            ]
        ],
        F.count("profit_margin_pct").alias("margin_rows"),
        F.sum(F.col("profit_margin_pct").cast("decimal(28,12)")).cast(MARGIN_SUM).alias("margin_sum"),
        *([F.count_distinct("order_id").alias("orders")] if with_orders else []),
    )


def product_totals(sales: DataFrame, costs: DataFrame | None = None, keys=()) -> DataFrame:
    """Totals by product and `keys`. Without a cost table the rows are the stored sales fact, cost included."""
    if costs is None:
        return sales_totals(sales, "product_id", *keys)
    return attach_costs(item_totals(sales, "product_id", *keys), costs, *keys)


def key_totals(sales: DataFrame, costs: DataFrame | None, keys=()) -> DataFrame:
    """Totals by `keys` alone. Raw items go by product first, to get their cost; the stored fact need not."""
    if costs is None:
        return roll_up(sales_totals(sales, *keys), keys)
    return roll_up(product_totals(sales, costs, keys), keys)


def order_totals(sales: DataFrame, costs: DataFrame | None, keys=()) -> DataFrame:
    """key_totals with `orders`, the distinct orders of each group: both from one pass over the fact."""
    if costs is None:
        return roll_up(sales_totals(sales, *keys, with_orders=True), keys, ("orders",))
    joined = item_totals_with_orders(sales, *keys).join(costs.select("product_id", "cost_price"), "product_id", "left")
    return roll_up(_with_cost_measures(joined, ["product_id", *keys, "orders"]), keys, ("orders",))


def roll_up(totals: DataFrame, keys=(), further=()) -> DataFrame:
    """Totals of totals on fewer keys; no key gives one row. `further`: more columns to add up."""
    keys = as_list(keys)
    kept = with_keys(totals, keys) if keys else totals
    sums = [F.coalesce(F.sum(F.col(c).cast("decimal(28,0)")), F.lit(0)).alias(c) for c in [*TOTALS, *further]]
    return kept.groupBy(*keys).agg(*sums, F.sum("margin_sum").cast(MARGIN_SUM).alias("margin_sum"))


def items_count() -> Column:
    return F.col("items").cast("bigint")


def orders_count() -> Column:
    return F.col("orders").cast("bigint")


def revenue() -> Column:
    return money(F.col("revenue_cents"))


def cost() -> Column:
    return money(F.col("cost_cents"))


def profit() -> Column:
    return money(F.col("profit_cents"))


def margin_pct() -> Column:
    """Ratio of sums."""
    return ratio_pct(profit(), revenue())


def avg_margin_pct() -> Column:
    """Unweighted mean of the row margins."""
    return F.round(F.try_divide(F.col("margin_sum").cast("double"), F.col("margin_rows").cast("double")), 6)


def roi_pct(budget: Column) -> Column:
    return ratio_pct(profit() - budget, budget)
