import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marginmill.operators.answers import adhoc_sql
from marginmill.operators.campaigns import campaign_roi
from marginmill.operators.categories import category_detail
from marginmill.operators.features import sales_features
from marginmill.plans.shop import FEATURES, load_shop, with_remembered_totals, with_stored_features, write_features
from marginmill.sources import tables

from .conftest import rows_of

CSV = {
    "customers": "customer_id,customer_unique_id,city\nc1,u1,Lima\nc2,u2,Oslo\n",
    "orders": "order_id,order_status,customer_id,order_purchase_timestamp\no1,ok,c1,2017-10-02 10:56:33\no2,ok,c2,\n",
    "products": "product_id,product_category_name\np1,brinquedos\np2,\n",
    "order_items": "order_id,item,product_id,price\no1,1,p1,58.90\no1,2,p2,12.10\no2,1,p1,61.10\n",
    "payments": "order_id,payment_value\no1,71.00\no2,61.10\n",
    "category_translation": "﻿product_category_name,product_category_name_english\nbrinquedos,toys\n",
}


@pytest.fixture
def csv_directory(tmp_path):
    for name, text in CSV.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_csv_columns_are_found_by_name_and_typed(spark, csv_directory):
    items = tables.read_table(spark, "order_items", csv_directory, "csv")
    assert [(f.name, f.dataType.simpleString()) for f in items.schema] == [
        ("order_id", "string"),
        ("item", "string"),
        ("product_id", "string"),
        ("price", "double"),
    ]
    orders = tables.read_table(spark, "orders", csv_directory, "csv")
    assert orders.schema["order_purchase_timestamp"].dataType.simpleString() == "timestamp_ntz"
    assert orders.filter("order_purchase_timestamp is null").count() == 1


def test_byte_order_mark_is_not_part_of_the_name(spark, csv_directory):
    translation = tables.read_table(spark, "category_translation", csv_directory, "csv")
    assert translation.columns == ["product_category_name", "product_category_name_english"]


def test_profile_and_preview(spark, csv_directory):
    profiles = {r.table_name: r for r in tables.profile_all(tables.load_all(spark, csv_directory, "csv")).collect()}
    assert len(profiles) == 5
    assert profiles["customers"].asDict() == {
        "table_name": "customers",
        "row_count": 2,
        "column_count": 3,
        "column_names": "customer_id, customer_unique_id, city",
    }
    assert tables.preview(spark.range(9), 5).count() == 5


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_feature_jobs_write_tables_that_give_the_same_reports(spark, csv_directory, tmp_path, fmt):
    shop = load_shop(spark, csv_directory, "csv")
    out = str(tmp_path / "features")
    write_features(spark, shop, out, fmt)
    again = write_features(spark, shop, out, fmt)  # Full overwrite.
    assert again.sales.count() == 3 and again.segments.count() == 2
    stored = with_stored_features(spark, shop, out, fmt)
    for name in FEATURES:
        assert tables.read_table(spark, name, out, fmt).count() > 0
    assert rows_of(category_detail(shop.category_totals)) == rows_of(category_detail(stored.category_totals))
    assert sorted(rows_of(shop.forecast_base)) == sorted(rows_of(stored.forecast_base))
    assert rows_of(campaign_roi(stored.campaign_totals, stored.campaigns)) == rows_of(shop.campaign_roi)
    assert rows_of(shop.segment_summary(False).orderBy("segment")) == rows_of(stored.segment_summary(False).orderBy("segment"))
    assert "order_items" not in str(stored.campaign_totals.inputFiles())


def test_a_small_stored_cost_table_is_broadcast_and_the_fact_not_shuffled(spark, csv_directory, tmp_path):
    shop = load_shop(spark, csv_directory, "csv")
    shop.items.write.parquet(str(tmp_path / "items.parquet"))
    tables.write_table(shop.costs, str(tmp_path / "product_costs.parquet"))
    items = spark.read.parquet(str(tmp_path / "items.parquet"))
    sales = sales_features(items, tables.read_table(spark, "product_costs", str(tmp_path)))
    plan = sales._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sales.count() == 3


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_a_lost_write_leaves_the_table_as_it_was(spark, tmp_path, fmt):
    def costs(rows):
        return spark.createDataFrame(rows, "product_id string, cost_price double")

    def read():
        return sorted(rows_of(tables.read_table(spark, "product_costs", str(tmp_path), fmt)))

    path = str(tmp_path / f"product_costs.{fmt}")
    tables.write_table(costs([("a", 1.0), ("b", 2.0)]), path, fmt)
    half = spark.range(0, 100, 1, 4).select(
        F.col("id").cast("string").alias("product_id"),
        F.when(F.col("id") < 90, 0.5).otherwise(F.raise_error(F.lit("lost")).cast("double")).alias("cost_price"),
    )
    with pytest.raises(PySparkException):
        tables.write_table(half, path, fmt)
    assert read() == [("a", 1.0), ("b", 2.0)]
    begun = tables.read_table(spark, "product_costs", str(tmp_path), fmt)
    # Written over the table that it reads.
    tables.write_table(begun.select("product_id", (F.col("cost_price") * 2).alias("cost_price")), path, fmt)
    assert read() == [("a", 2.0), ("b", 4.0)] and sorted(rows_of(begun)) == [("a", 1.0), ("b", 2.0)]
    for n in range(3):
        tables.write_table(costs([("c", float(n))]), path, fmt)
    assert read() == [("c", 2.0)]
    # The versions of lost jobs and old ones are gone, and so are drafts of the pointer.
    names = sorted(f.name for f in (tmp_path / f"product_costs.{fmt}").iterdir() if not f.name.endswith(".crc"))
    assert names[0] == tables.POINTER and len(names) == 3 and all(n.startswith("v-") for n in names[1:])


def test_a_table_without_versions_is_read_as_it_is(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "plain.parquet"))
    assert tables.current_version(spark, str(tmp_path / "plain.parquet")) == str(tmp_path / "plain.parquet")
    assert tables.current_version(spark, str(tmp_path / "none.parquet")) == str(tmp_path / "none.parquet")


def test_rows_that_cannot_be_read_are_set_aside_with_a_reason(spark, tmp_path):
    folder = tmp_path / "order_items.csv"
    folder.mkdir()
    header = "order_id,item,product_id,price\n"
    (folder / "1.csv").write_text(header + "o1,1,p1,58.90\no1,2,p2,cheap\no2,1,p1\n", encoding="utf-8")
    (folder / "2.csv").write_text(header + 'o3,1,p1,\n"o,4",1,p1,1e2\no5,1,p1,7,extra\n', encoding="utf-8")
    kept, aside = tables.read_checked(spark, "order_items", str(tmp_path))
    assert kept.schema == tables.read_table(spark, "order_items", str(tmp_path), "csv").schema
    assert sorted(rows_of(kept), key=str) == [("o,4", "1", "p1", 100.0), ("o1", "1", "p1", 58.9), ("o3", "1", "p1", None)]
    found = {(r.table_name, r.file.rsplit("/", 1)[-1], r.reason, r.row) for r in aside.collect()}
    assert found == {
        ("order_items", "1.csv", "price is no double", "o1,2,p2,cheap"),
        ("order_items", "1.csv", "not 4 fields", "o2,1,p1"),
        ("order_items", "2.csv", "not 4 fields", "o5,1,p1,7,extra"),
    }
    # The counts alone, which need no column, add up as well.
    assert (kept.count(), aside.count()) == (3, 3)
    for n in (0, 1):
        empty = tmp_path / f"none{n}"
        empty.mkdir()
        (empty / "orders.csv").write_text("order_id,customer_id,order_purchase_timestamp\n" + "o1,c1,soon\n" * n)
        kept, aside = tables.read_checked(spark, "orders", str(empty))
        assert (kept.count(), [r.reason for r in aside.collect()]) == (0, ["order_purchase_timestamp is no timestamp_ntz"] * n)


def test_totals_are_worked_out_again_only_when_a_file_changes(spark, csv_directory, tmp_path):
    out = str(tmp_path / "totals")

    def load(session=spark, **options):
        return with_remembered_totals(session, load_shop(session, csv_directory, "csv", **options), out)

    def version(name="product_totals"):
        return tables.current_version(spark, f"{out}/{name}.parquet")

    plain = load_shop(spark, csv_directory, "csv")
    first = load()
    assert rows_of(category_detail(first.category_totals)) == rows_of(category_detail(plain.category_totals))
    assert sorted(rows_of(first.forecast_base)) == sorted(rows_of(plain.forecast_base))
    assert sorted(rows_of(first.campaign_roi)) == sorted(rows_of(plain.campaign_roi))
    assert all("order_items" not in f for f in first.category_totals.inputFiles())
    written = version()
    load(spark.newSession())
    assert version() == written
    load(thresholds=[(1.0, "Premium")])
    assert version() != written
    with open(f"{csv_directory}/order_items.csv", "a") as f:
        f.write("o2,2,p1,10.00\n")
    assert load().product_totals.agg(F.sum("items")).first()[0] == 4
    with pytest.raises(ValueError):
        tables.inputs_key(spark, [spark.range(1)])


def test_catalog_tables(spark):
    try:
        tables.save_table(spark.range(3), "numbers")
        tables.save_table(spark.range(5), "numbers")
        spark.range(1).createOrReplaceTempView("only_a_view")
        names = [r.name for r in tables.list_tables(spark).collect()]
        assert "numbers" in names and "only_a_view" not in names
        assert tables.sql_select(spark, "SELECT count(*) AS n FROM numbers").first().n == 5
    finally:
        spark.sql("DROP TABLE IF EXISTS numbers")


def test_tables_bucketed_on_the_order_join_without_a_shuffle(spark):
    items = spark.range(2000).select((F.col("id") % 500).alias("order_id"), F.col("id").alias("product_id"))
    mapping = spark.range(500).select(F.col("id").alias("order_id"), F.lit("C001").alias("campaign_id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        tables.save_table(items, "bucketed_items", "order_id", 4)
        tables.save_table(mapping, "bucketed_mapping", "order_id", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("bucketed_items").join(spark.table("bucketed_mapping"), "order_id", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS bucketed_items")
        spark.sql("DROP TABLE IF EXISTS bucketed_mapping")


def test_cached_keeps_the_frame(spark):
    df = tables.cached(spark.range(10))
    assert df.count() == 10 and df.storageLevel.useMemory and df.storageLevel.useDisk
    df.unpersist()


def test_adhoc_sql_runs_one_query_and_nothing_else(spark):
    given = {"numbers": spark.range(50)}
    fenced = "```sql\nSELECT id FROM numbers ORDER BY id DESC -- newest first\n```"
    assert [r.id for r in adhoc_sql(spark, fenced, given).collect()] == list(range(49, 29, -1))
    assert adhoc_sql(spark, "WITH a AS (SELECT 1 AS x), b (y) AS (SELECT 2) SELECT * FROM a, b;").count() == 1
    nested = "SELECT * FROM (WITH n AS (SELECT id FROM numbers), m AS (SELECT max(id) AS x FROM N) SELECT x FROM m) WHERE x > 0"
    assert adhoc_sql(spark, nested, given).first().x == 49
    assert adhoc_sql(spark, "SELECT 'a```b' AS x, \"it's\" AS y").first().x == "a```b"
    assert adhoc_sql(spark, "SELECT * FROM numbers n JOIN NUMBERS m USING (id) WHERE id IN (SELECT id FROM numbers)", given).count() == 20
    for text in [
        "DROP VIEW numbers",
        "CREATE TABLE t AS SELECT 1",
        "INSERT INTO numbers VALUES (1)",
        "SELECT 1; SELECT 2",
        "SELECT 1) AS a; DROP VIEW numbers; SELECT * FROM (SELECT 1",
        "SELECT 1 AS a) AS x, (SELECT 2 AS b",
        "SET spark.sql.ansi.enabled=false",
    ]:
        with pytest.raises(PySparkException):
            adhoc_sql(spark, text, given).collect()
    spark.range(3).createOrReplaceTempView("of_another")
    for text in [
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT Java_Method('java.lang.System', 'getProperty', 'user.home') FROM numbers",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
        "SELECT * FROM numbers WHERE id IN (SELECT o_orderkey FROM parquet.`/root/testdata/sf0.001/orders.parquet`)",
        "WITH a AS (SELECT * FROM of_another) SELECT * FROM a",
        "SELECT * FROM of_another WHERE ', of_another as (' <> ''",
        "SELECT 1 /* with of_another as ( */ FROM `of_another`",
        "SELECT * FROM of_another WHERE EXISTS (WITH of_another AS (SELECT 1) SELECT * FROM of_another)",
        "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
        "WITH of_another AS (SELECT * FROM of_another) SELECT * FROM of_another",
        "SELECT (SELECT max(id) FROM of_another) AS x FROM numbers",
        "SELECT * FROM numbers, LATERAL (SELECT * FROM of_another WHERE of_another.id = numbers.id)",
        "SELECT * FROM numbers WHERE id IN (SELECT id FROM numbers UNION SELECT id FROM of_another)",
        "SELECT * FROM IDENTIFIER('of_' || 'another')",
    ]:
        with pytest.raises(ValueError):
            adhoc_sql(spark, text, given)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("adhoc_")] == []
    spark.catalog.dropTempView("of_another")


def test_a_shop_may_have_campaigns_of_its_own(spark, csv_directory, tmp_path):
    import shutil

    shop_folder = tmp_path / "shop"
    shutil.copytree(csv_directory, shop_folder)
    header = "campaign_id,campaign_name,channel,discount_pct,budget\n"
    (shop_folder / "campaigns.csv").write_text(header + "X1,One,Email,10,50\nX2,Two,SMS,20,70\n")
    shop = load_shop(spark, str(shop_folder), "csv")
    assert {r.campaign_id for r in shop.mapping.collect()} <= {"X1", "X2"}
    found = {r.campaign_id: (r.campaign_name, r.budget) for r in shop.campaign_roi.collect()}
    assert found and all(found[i] == {"X1": ("One", 50), "X2": ("Two", 70)}[i] for i in found)
    assert {r.discount_pct for r in shop.discount_performance.collect()} <= {10, 20}
