"""Time the headline queries: one JSON line with seconds per query and their sum. Each query runs once before it is
timed, so that the figures show its plan and not the compiler warming up.

BENCH_SF_DIR names the table directory, BENCH_CPUS the local cores, BENCH_QUERIES (comma-separated) other queries.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from marginmill.plans import catalogue
from marginmill.session import tuned

HEADLINE = [
    "q03_product_costs",
    "q06_sales_features",
    "q07_sales_stats",
    "q08_customer_segments",
    "q10_kpi_summary",
    "q11_executive_kpis",
    "q13_top_products_by_category",
    "q14_monthly_trend",
    "q20_category_performance",
    "q24_category_campaign",
    "q25_top_products_in_category",
    "q28_promotion_recommendations",
    "q29_strategy_advice",
    "q32_segment_summary",
    "q33_segment_top_categories",
    "q35_campaign_roi",
    "q35_campaign_roi_drawn",
    "q36_campaign_performance",
    "q41_discount_performance",
    "q44_promotion_forecast",
    "q47_forecast_with_advice",
    "q53_adhoc_sql",
    "q54_tag_intents",
    "j13_sales_wide",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = (
        tuned(SparkSession.builder)
        .master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.registered()

    def run(name):
        queries[name](spark, directory).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names.split(",") if names else HEADLINE:
        run(name)
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "sum of headline query times, second run",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
