"""Session settings the plans are made for. They are hints to Spark; results do not depend on them."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan at run time: measured broadcasts, merged small partitions, split large ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
