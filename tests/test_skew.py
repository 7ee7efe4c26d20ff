"""Reports over skewed shops against row-by-row pandas: one product, order, customer or category has a third of all."""

import random

import pandas as pd
import pytest

from marginmill.operators import categories, kpis, segments

from .conftest import rows_of

N = 3000


def skewed(kind):
    rng = random.Random(kind)

    def key(prefix, n, hot):
        return f"{prefix}0" if hot and rng.random() < 1 / 3 else f"{prefix}{rng.randrange(n)}"

    orders = [(f"o{i}", key("c", 40, kind == "customer"), None) for i in range(400)]
    products = [(f"p{i}", key("k", 6, kind == "category")) for i in range(60)]
    items = [
        (key("o", 410, kind == "order"), key("p", 65, kind == "product"), round(rng.uniform(0, 300), 2))
        for _ in range(N)
    ]
    return dict(
        order_items=items,
        orders=orders,
        products=products,
        customers=[(f"c{i}", f"u{i}") for i in range(42)],
        category_translation=[(f"k{i}", f"cat{i}") for i in range(5)],
        costs=[(f"p{i}", round(rng.uniform(10, 150), 2)) for i in range(62)],
    )


def wide(data):
    df = pd.DataFrame(data["order_items"], columns=["order_id", "product_id", "price"])
    df = df.merge(pd.DataFrame(data["costs"], columns=["product_id", "cost"]), how="left")
    products = pd.DataFrame(data["products"], columns=["product_id", "k"])
    translation = pd.DataFrame(data["category_translation"], columns=["k", "category"])
    df = df.merge(products.merge(translation, how="left"), how="left")
    orders = pd.DataFrame(data["orders"], columns=["order_id", "customer_id", "t"])
    df = df.merge(orders, how="left")
    df["profit"] = df.price - df.cost
    df["margin"] = (df.profit / df.price.where(df.price != 0)) * 100
    return df


@pytest.mark.parametrize("kind", ["product", "order", "customer", "category"])
def test_reports(make_shop, kind):
    data = skewed(kind)
    shop, df = make_shop(**data), wide(data)

    want = df.groupby("category").agg(r=("price", "sum"), p=("profit", "sum"), m=("margin", "mean"), n=("price", "size"))
    got = {r.category: r for r in categories.category_performance(shop.category_totals).collect()}
    assert set(got) == set(want.index)
    for category, row in want.iterrows():
        r = got[category]
        assert (r.revenue, r.profit, r.volume) == (round(row.r, 2), round(row.p, 2), row.n)
        assert r.avg_margin_pct == pytest.approx(row.m, abs=1e-6)

    kpi = kpis.kpi_summary(shop.whole_totals).first()
    assert (kpi.total_revenue, kpi.total_orders) == (round(df.price.sum(), 2), df.order_id.nunique())

    known = df[df.customer_id.notna()]
    spend = known.groupby("customer_id").price.mean()
    label = spend.map(lambda v: "Premium" if v >= 170 else "High Value" if v >= 100 else "Regular" if v >= 50 else "Occasional")
    found = {r.customer_id: r.customer_segment for r in shop.segments.collect()}
    assert found == {c: label.get(c, "Occasional") for c, _ in data["customers"]}

    known = known.assign(segment=known.customer_id.map(label))
    want = known.groupby("segment").agg(r=("price", "sum"), p=("profit", "sum"), n=("order_id", "nunique"))
    got = {r.segment: (r.revenue, r.profit, r.total_orders) for r in shop.segment_summary(False).collect()}
    assert got == {s: (round(row.r, 2), round(row.p, 2), row.n) for s, row in want.iterrows()}

    mapping = {r.order_id: r.campaign_id for r in shop.mapping.collect()}
    assert set(mapping) == {o for o, _, _ in data["orders"]}
    mapped = df.assign(campaign=df.order_id.map(mapping)).dropna(subset=["campaign"])
    want = mapped.groupby("campaign").agg(r=("price", "sum"), p=("profit", "sum"))
    assert {r.campaign_id: (r.revenue, r.gross_profit) for r in shop.campaign_roi.collect()} == {
        c: (round(row.r, 2), round(row.p, 2)) for c, row in want.iterrows()
    }

    top = segments.segment_top_categories(shop.segment_product_totals, shop.products_tr, 2)
    assert len(rows_of(top)) == 2 * known.segment.nunique()


def test_parts_add_up_to_the_whole(make_shop):
    data = skewed("product")
    shop = make_shop(**data)
    whole = kpis.kpi_summary(shop.whole_totals).first()
    parts = categories.category_sums(shop.category_totals_with_unknown).collect()
    assert sum(r.revenue for r in parts) == pytest.approx(whole.total_revenue)
    assert sum(r.gross_profit for r in parts) == pytest.approx(whole.total_profit)
    assert shop.segments.count() == len(data["customers"])
    base = shop.forecast_base.collect()
    assert all(r.base_units > 0 for r in base) and len(base) == 5 * 5
