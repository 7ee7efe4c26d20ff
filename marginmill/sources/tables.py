"""Scans, sinks and catalog tables."""

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..fixed_values import CAMPAIGNS
from ..schemas import COLUMNS, RAW_TABLES


def read_table(spark: SparkSession, name: str, directory: str, fmt: str = "parquet") -> DataFrame:
    """One logical table. CSV columns are found by header name and cast, never inferred by a pass over the data."""
    path = current_version(spark, f"{directory.rstrip('/')}/{name}.{fmt}")
    known = COLUMNS[name]
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(c).cast(known[c]).alias(c) if c in known else F.col(c) for c in raw.columns])


def read_checked(spark: SparkSession, name: str, directory: str) -> tuple[DataFrame, DataFrame]:
    """A table of CSV files as its rows that can be read and those set aside: file, reason and the row as text. Set aside are
    rows with too few or too many fields, and rows in which a field does not fit its column's type; an empty field is NULL and
    fits. Every row is in exactly one of the two. Both are lazy scans; a job that keeps both writes each once. The files
    have one header."""
    path = current_version(spark, f"{directory.rstrip('/')}/{name}.csv")
    known = COLUMNS[name]
    columns = spark.read.csv(path, header=True).columns
    schema = ", ".join(f"`{c}` string" for c in [*columns, BROKEN])
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "columnPruning": False}
    raw = spark.read.schema(schema).options(**options).csv(path).select("*", F.col("_metadata.file_path").alias("_file"))
    typed = [c for c in columns if known.get(c, "string") != "string"]
    misfits = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(known[c]).isNull(), F.lit(f"{c} is no {known[c]}")) for c in typed]
    fields = F.when(F.col(BROKEN).isNotNull(), F.lit(f"not {len(columns)} fields"))
    reason = F.coalesce(fields, F.nullif(F.concat_ws(", ", *misfits), F.lit("")))
    judged = raw.withColumn("_reason", reason)
    kept = judged.filter(F.col("_reason").isNull()).select(
        *[F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in columns]
    )
    as_text = F.coalesce(F.col(BROKEN), F.to_csv(F.struct(*columns)))
    aside = judged.filter(F.col("_reason").isNotNull()).select(
        F.lit(name).alias("table_name"), F.col("_file").alias("file"), F.col("_reason").alias("reason"), as_text.alias("row")
    )
    return kept, aside


# The column in which a CSV scan leaves a row that has other fields than the header.
BROKEN = "_broken"


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, name: str, directory: str, fmt: str = "parquet") -> bool:
    path, files = _path(spark, f"{directory.rstrip('/')}/{name}.{fmt}")
    return files.exists(path)


# A table written here is a folder of versions and a pointer, a file that names the one to read.
POINTER = "_current"


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of the version that the pointer names; of a table without versions the path itself."""
    pointer, files = _path(spark, f"{path}/{POINTER}")
    if not files.exists(pointer):
        return path
    stream = files.open(pointer)
    try:
        return f"{path}/{stream.readLine()}"
    finally:
        stream.close()


def load_all(spark: SparkSession, directory: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: read_table(spark, name, directory, fmt) for name in RAW_TABLES}


def profile(df: DataFrame, name: str) -> DataFrame:
    """Rows, columns and column names as one row."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"),
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(", ".join(df.columns)).alias("column_names"),
    )


def profile_all(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [profile(df, name) for name, df in tables.items()])


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First n rows in the order of all columns."""
    return df.orderBy(*df.columns).limit(n)


def campaigns(spark: SparkSession) -> DataFrame:
    """The campaign table as an inline relation, whose exact size the optimizer knows."""
    rows = ", ".join(f"('{i}', '{n}', '{c}', {d}, {b})" for i, n, c, d, b in CAMPAIGNS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(campaign_id, campaign_name, channel, discount_pct, budget)")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", keep: int = 2, label: str = "") -> None:
    """Full replace. The rows go to a folder of their own; only when it is whole is the pointer replaced, by one rename.
    A job that is lost on the way leaves the table as it was, and a reader sees the old rows or the new. The last `keep`
    versions stay for readers that have begun, so a frame may be written over the table it reads; older ones, and those of
    lost jobs, are deleted by the next write. One job at a time may write a table."""
    spark, path = df.sparkSession, path.rstrip("/")
    before = current_version(spark, path)
    version = f"v-{label}{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(f"{path}/{version}")
    point_to(spark, path, version)
    _drop_versions(spark, path, {version, before.rsplit("/", 1)[-1]}, keep)


def point_to(spark: SparkSession, path: str, version: str) -> None:
    """Make `version` the one that `current_version` finds, by one rename."""
    folder, files = _path(spark, path)
    draft, pointer = (_path(spark, f"{path}/{name}")[0] for name in (f"{POINTER}.{version}", POINTER))
    stream = files.create(draft, True)
    stream.writeBytes(version + "\n")
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), files.getConf())
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(files.makeQualified(draft), files.makeQualified(pointer), options)


def _drop_versions(spark: SparkSession, path: str, kept: set, keep: int) -> None:
    """Delete versions but those in `kept` and the newest `keep`."""
    folder, files = _path(spark, path)
    versions = [s for s in files.listStatus(folder) if s.getPath().getName().startswith("v-")]
    versions.sort(key=lambda s: s.getModificationTime(), reverse=True)
    for status in versions[keep:]:
        if status.getPath().getName() not in kept:
            files.delete(status.getPath(), True)


def save_table(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 0) -> None:
    """Full replace of a catalog table; tables bucketed on one key join on it without a shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES").filter("NOT isTemporary").select(F.col("tableName").alias("name"))


def sql_select(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """A query; frames stand in it under their names in braces, without views of the session."""
    return spark.sql(text, **frames)


def cached(df: DataFrame) -> DataFrame:
    """Keep a joined dataset for several operators; blocks lost with an executor are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def inputs_key(spark: SparkSession, sources: list[DataFrame], settings: str = "") -> str:
    """A hash of names, sizes and times of all files the frames read, and of settings. One aggregate over the files' metadata;
    no file is opened."""
    files = sorted({f for df in sources for f in df.inputFiles()})
    if not files:
        raise ValueError("no files to tell a change by")
    found = spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    parts = [F.xxhash64("path", "length", "modificationTime", F.lit(seed)) for seed in (0, 1)]
    row = found.agg(F.count(F.lit(1)), F.sum("length"), *[F.bit_xor(part) for part in parts]).first()
    return hashlib.sha256(repr((*row, settings)).encode()).hexdigest()[:32]


def remembered(df: DataFrame, path: str, sources: list[DataFrame], settings: str = "") -> DataFrame:
    """`df` as a table at `path`, worked out only if the files of `sources`, all that it is made from, or `settings` have
    changed since it was written, be it by another session. The key is taken before the work, so files that change
    meanwhile make the next call work it out again. `path` stands for what is computed: give another for another query."""
    spark, label = df.sparkSession, f"{inputs_key(df.sparkSession, sources, settings)}-"
    if not current_version(spark, path).rsplit("/", 1)[-1].startswith(f"v-{label}"):
        write_table(df, path, label=label)
    return spark.read.parquet(current_version(spark, path))
