"""Generic filters, aggregates, sorts and top-k. Rows whose group key is NULL belong to no group."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import UNKNOWN
from ..functions.columns import cents, from_units, money, ratio_pct, round_even, whole_units


def as_list(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def with_keys(df: DataFrame, keys) -> DataFrame:
    return df.filter(reduce(and_, [F.col(k).isNotNull() for k in as_list(keys)]))


#: A heavy key has more than this share of all rows, so there are fewer than its inverse; the sketch of a task tracks so many
#: keys, which puts its error well below that share.
HEAVY_SHARE, TRACKED = 1 / 1000, 10_000


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """One row: `keys`, an array of all keys (not NULL) with more than `share` of the rows, fewer than 1 / share. A mergeable
    sketch of frequent items in each task, so only the key column is read and nothing is shuffled by key."""
    sketch = F.expr(f"approx_top_k({key}, {round(1 / share)}, {TRACKED})").alias("top")
    found = df.agg(sketch, F.count(F.lit(1)).alias("rows"))
    often = F.filter("top", lambda x: x["item"].isNotNull() & (x["count"] > F.col("rows") * share))
    return found.select(F.transform(often, lambda x: x["item"]).alias("keys"))


def spread_join(
    df: DataFrame, table: DataFrame, key: str, how: str = "left", counted: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """Join many rows to a table when one key may have a large share of the rows. Rows of heavy keys, and those without a
    key, are spread over `parts` tasks (as many as a shuffle has, 1000 at most) by a hash of the whole row, and only the
    table's rows of heavy keys are repeated for each of them; all others are joined plainly. `counted`: where the keys are
    counted instead, if `df` takes work to make."""
    parts = parts or min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1000)
    heavy = heavy_keys(df if counted is None else counted, key).scalar()
    is_heavy = F.array_contains(heavy, F.col(key))
    part = F.when(F.col(key).isNull() | is_heavy, F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")).otherwise(0)
    copies = F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    return df.withColumn("_part", part).join(table.withColumn("_part", copies), [key, "_part"], how).drop("_part")


def filter_opt(df: DataFrame, col: str, value=None) -> DataFrame:
    """Equality filter; None means all rows."""
    return df if value is None else df.filter(F.col(col) == F.lit(value))


def fill_unknown(df: DataFrame, col: str, value=UNKNOWN) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values, without NULL and without the stand-in for unknown."""
    return df.filter(F.col(col) != UNKNOWN).select(col).distinct().orderBy(col)


def money_mean(col: str):
    """Mean of a money column from its exact sum."""
    return F.try_divide(money(F.sum(cents(F.col(col)))), F.count(col))


def column_sum(col: str, digits: int | None = None):
    """Sum of a column in its own type, or exact where its values have at most so many decimals (more are an error);
    0 where there is nothing to add."""
    found = F.sum(col) if digits is None else from_units(F.sum(whole_units(F.col(col), digits)), digits)
    return F.coalesce(found, F.lit(0.0))


def total(df: DataFrame, col: str, digits: int | None = None) -> DataFrame:
    return df.agg(column_sum(col, digits).alias(col))


def mean(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.avg(col).alias(col))


def month_range(df: DataFrame, col: str, low: str, high: str) -> DataFrame:
    """Rows whose timestamp lies in the months low to high ('yyyy-MM'). The bounds are timestamps, so that the filter
    reaches the scan."""
    first = F.lit(f"{low}-01").cast("date").cast("timestamp_ntz")
    past = F.add_months(F.lit(f"{high}-01").cast("date"), 1).cast("timestamp_ntz")
    return df.filter((F.col(col) >= first) & (F.col(col) < past))


def n_distinct(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(F.col(col)).alias(col))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def group_agg(
    df: DataFrame, keys, *, sums=None, means=None, money_means=None, counts=None, distinct=None, digits=None
) -> DataFrame:
    """All measures of a grouping in one pass. Each argument maps an output name to an input column. Sums and means
    are those of the columns' own types; with `digits` sums are exact for columns of so many decimals, and money_means are
    exact means of money columns."""
    measures = [column_sum(c, digits).alias(n) for n, c in (sums or {}).items()]
    measures += [F.avg(c).alias(n) for n, c in (means or {}).items()]
    measures += [money_mean(c).alias(n) for n, c in (money_means or {}).items()]
    measures += [F.count(c).alias(n) for n, c in (counts or {}).items()]
    measures += [F.count_distinct(F.col(c)).alias(n) for n, c in (distinct or {}).items()]
    return with_keys(df, keys).groupBy(*as_list(keys)).agg(*measures)


def group_sum(df: DataFrame, key: str, col: str, digits: int | None = None) -> DataFrame:
    return group_agg(df, key, sums={col: col}, digits=digits)


def value_counts(df: DataFrame, col: str, name: str = "rows") -> DataFrame:
    counts = with_keys(df, col).groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.desc(name), F.asc(col))


def ratio_of_sums(df: DataFrame, keys, num: str, den: str, name: str, digits: int | None = None) -> DataFrame:
    sums = group_agg(df, keys, sums={"_num": num, "_den": den}, digits=digits)
    return sums.select(*as_list(keys), ratio_pct(F.col("_num"), F.col("_den")).alias(name))


def benchmark(groups: DataFrame, cols, digits: int | None = None) -> DataFrame:
    """Mean over group totals, one row; with `digits` from exact sums."""
    if digits is None:
        return groups.agg(*[F.avg(c).alias(c) for c in as_list(cols)])
    return groups.agg(*[F.try_divide(from_units(F.sum(whole_units(F.col(c), digits)), digits), F.count(c)).alias(c) for c in as_list(cols)])


def round_cols(df: DataFrame, cols, digits: int = 2) -> DataFrame:
    return df.withColumns({c: round_even(F.col(c), digits) for c in as_list(cols)})


def ranked(df: DataFrame, by: str, key) -> DataFrame:
    """Descending by a measure; equal measures in key order."""
    return df.orderBy(F.desc_nulls_last(by), *[F.asc(k) for k in as_list(key)])


def ordered(df: DataFrame, by) -> DataFrame:
    return df.orderBy(*[F.asc_nulls_last(c) for c in as_list(by)])


def top_k(df: DataFrame, by: str, k: int, key) -> DataFrame:
    return ranked(df, by, key).limit(k)


def top1(df: DataFrame, by: str, key) -> DataFrame:
    return top_k(df, by, 1, key)


def arg_max(df: DataFrame, key: str, col: str) -> DataFrame:
    return top1(df.filter(F.col(col).isNotNull()), col, key).select(key, col)


def top_k_per_group(df: DataFrame, group: str, by: str, k: int, key) -> DataFrame:
    """The k best rows of every group; each task keeps k per group before the shuffle."""
    place = Window.partitionBy(group).orderBy(F.desc_nulls_last(by), *[F.asc(c) for c in as_list(key)])
    return df.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
