import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginmill.functions import columns as fn
from marginmill.operators.answers import apply_glossary, intent_counts, tag_intents

from .conftest import rows_of


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_rounding_is_half_even_like_numpy(spark):
    values = [0.125, 0.375, 2.675, 1.005, -0.125, -2.5, 0.5, 1.5, 2.5, 1e9 + 0.125]
    out = rows_of(column(spark, values, "double").select(fn.bround2(F.col("x")), fn.round_int(F.col("x"))))
    assert [a for a, _ in out] == [float(np.round(v, 2)) for v in values]
    assert [b for _, b in out] == [int(round(v)) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=200))
def test_cents_round_trip(spark, values):
    df = column(spark, [v / 100 for v in values], "double")
    cents, money = df.agg(F.sum(fn.cents(F.col("x"))), fn.money(F.sum(fn.cents(F.col("x"))))).first()
    assert cents == sum(values)
    assert money == sum(values) / 100


@pytest.mark.parametrize("text", ["health_beauty", "new york-city", "it's 2nd", "ÄRGER über", "", "a  b", "x9y"])
def test_title(spark, text):
    assert column(spark, [text], "string").select(fn.title(F.col("x"))).first()[0] == text.title()


def test_guarded_ratios(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, -2.0), (1.0, 4.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    assert rows_of(df.select(fn.safe_ratio(a, b), fn.ratio_pct(a, b), fn.pct_change(b, a))) == [
        (0.0, None, None),
        (0.0, -50.0, -150.0),
        (0.25, 25.0, -75.0),
    ]


def test_recode_and_lookup(spark):
    df = column(spark, ["a", "z", None], "string")
    out = rows_of(df.select(fn.recode(F.col("x"), {"a": "A"}), fn.lookup({"a": "A"}, F.col("x"), "other")))
    assert out == [("A", "A"), (None, "other"), (None, "other")]


def test_draw_depends_on_the_key_alone(spark):
    one = spark.range(2000).select("id", fn.draw_choice(F.col("id"), ["a", "b", "c"]).alias("c"))
    other = spark.range(2000).repartition(7).select("id", fn.draw_choice(F.col("id"), ["a", "b", "c"]).alias("c"))
    assert one.exceptAll(other).count() == 0
    counts = [r["count"] for r in one.groupBy("c").count().collect()]
    assert len(counts) == 3 and min(counts) > 550
    low, high = spark.range(2000).select(fn.draw_fraction(F.col("id"), 0.5, 0.35).alias("f")).agg(F.min("f"), F.max("f")).first()
    assert 0.5 <= low < 0.51 and 0.84 < high < 0.85


def test_month_and_timestamp(spark):
    df = column(spark, ["2017-10-02 10:56:33"], "string").select(fn.to_ts(F.col("x")).alias("t"))
    month, start = df.select(fn.month_key(F.col("t")), fn.month_start(F.col("t")).cast("string")).first()
    assert (month, start) == ("2017-10", "2017-10-01")


INTENTS = [
    ("What discount makes the most profit?", "discount"),
    ("Which advertisement was the most worth the money?", "default"),
    ("Which customer type makes the most profit?", "segment"),
    ("What are the top product types by profit?", "category"),
    ("SELECT * FROM campaigns", "campaign"),
    ("select order_id from payments", "sql"),
    ("select something", "default"),
    ("A SWEET SPOT for the campaign", "discount"),
]


def test_intents(frame):
    asked = frame("questions", [(i, 0, text) for i, (text, _) in enumerate(INTENTS)])
    found = {r.conv_id: r.intent for r in tag_intents(asked).collect()}
    assert [found[i] for i in range(len(INTENTS))] == [intent for _, intent in INTENTS]
    assert rows_of(intent_counts(tag_intents(asked)))[0][1] == 2


def test_glossary_is_ordered_and_case_sensitive(frame):
    text = "Premium gross profit, revenue and Revenue; High Value ROI (%) of customer_segment"
    out = apply_glossary(frame("questions", [(1, 0, text)])).first().text
    assert out == "Big Spenders actual profit, sales and Revenue; Frequent Shoppers Worth / ROI % of customer type"
