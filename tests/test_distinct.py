from pyspark.sql import functions as F

from marginmill.operators import distinct
from marginmill.plans.shop import bind_star_schema, with_remembered_totals

from .conftest import rows_of

DIRECTORY = "/root/testdata/sf0.01"


def test_merged_sketches_are_as_close_as_their_bound(spark):
    """Values of a month return in the next, so sums of counts would be far off."""
    n = 120_000
    df = spark.range(0, n * 3, 1, 7).select(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 3).cast("int") * 31).alias("month"),
        (F.col("id") % 2).alias("side"),
        F.when(F.col("id") % 1000 != 7, F.floor(F.col("id") / 6)).alias("value"),
    )
    stored = distinct.sketches(df, ["month", "side"], {"values": "value"})
    for keys in ([], ["month"], ["side"], ["month", "side"]):
        exact = {r[:-1]: r[-1] for r in rows_of(distinct.exact_counts(df, keys, {"values": "value"}))} if keys else {
            (): df.agg(F.count_distinct("value")).first()[0]}
        found = {r[:-1]: r[-1] for r in rows_of(distinct.estimates(stored, keys, ["values"]))}
        assert found.keys() == exact.keys()
        assert all(abs(found[k] - exact[k]) <= 0.033 * exact[k] for k in exact)
    again = distinct.sketches(df.repartition(31), ["month", "side"], {"values": "value"})
    total = lambda s: distinct.estimates(s, [], ["values"]).first()[0]
    assert abs(total(again) - total(stored)) <= 0.033 * n / 2


def test_small_groups_nulls_and_no_rows(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", None), (None, 3)]
    df = spark.createDataFrame(rows, "key string, value bigint")
    stored = distinct.sketches(df, "key", {"values": "value"})
    assert sorted(rows_of(distinct.estimates(stored, "key", ["values"]))) == [("a", 2), ("b", 0)]
    assert rows_of(distinct.estimates(stored.filter("false"), [], ["values"]))[0][0] in (0, None)
    assert rows_of(distinct.estimates(stored.filter("false"), "key", ["values"])) == []


def test_a_span_is_counted_from_stored_sketches_without_the_fact(spark, tmp_path):
    plain = bind_star_schema(spark, DIRECTORY)
    shop = bind_star_schema(spark, DIRECTORY)
    # The inline tables of this shop have no files.
    shop.table = lambda name, table=shop.table: spark.createDataFrame([], table(name).schema) if name in ("campaigns", "category_translation") else table(name)
    stored = with_remembered_totals(spark, shop, str(tmp_path))
    spans = [("1996-01", "1996-01"), ("1995-06", "1998-02"), ("1990-01", "2005-12"), ("1980-01", "1980-02")]
    for low, high in spans:
        report = distinct.reach(stored.reach_sketches, low, high)
        assert all("lineitem" not in f and "orders" not in f.rsplit("/", 1)[-1] for f in report.inputFiles())
        exact = distinct.exact_counts(distinct.over_span(plain.sales_keys, low, high), "campaign_id", distinct.COUNTED)
        found, right = ({r[0]: r[1:] for r in rows_of(df)} for df in (report, exact))
        assert found.keys() == right.keys()
        assert all(abs(a - b) <= max(1, 0.033 * b) for k in right for a, b in zip(found[k], right[k]))
