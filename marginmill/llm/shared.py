"""Written intermediate tables in the folder that driver and executors share."""

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and driver and executors are one
    process, as in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.partition("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="marginmill-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a written table: the lineage ends there, and a lost executor costs a reread."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows in order with a number `row`, and the ends of each task. Rows are range-partitioned and sorted there;
    a number is the task (above 33 bits) and the place in it, so neighbours have neighbouring numbers except from one task
    to the next: `ends` has task, first and last, one row for each task."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = stored(ordered.withColumn("row", F.monotonically_increasing_id()), name)
    ends = ordered.groupBy(F.shiftright("row", 33).alias("task")).agg(F.min("row").alias("first"), F.max("row").alias("last"))
    return ordered, ends


#: Rows and bytes that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = "2000", "16m"


def ship_package(spark) -> None:
    """Send this package to the executors, unless it lies where their Python looks anyway; from then on the session hands
    texts to Python in batches that several workers of an executor can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = Path(__file__).resolve().parents[2]
    looked = [Path.cwd(), *map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))]
    if root in [p.resolve() for p in looked] or getattr(spark.sparkContext, "_marginmill_sent", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="marginmill-")) / "marginmill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "marginmill").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._marginmill_sent = True
