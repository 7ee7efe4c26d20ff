"""Summary statistics with exact quartiles that never shuffle a column or bring it into one task.

Values are whole counts of 10 ** -digits (finer ones are an error, NaN is missing). A first pass counts them per range of
65,536, which every task does on its own. The range that holds a quantile is found level by level: among at most 65,536
groups of groups of ranges, then among the groups in that one, then among its ranges. A second pass counts single values,
but only those in the ranges found: at most 65,536 distinct values each, whatever the number of rows. No window sees
more than 65,536 rows.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import from_units, whole_units

#: Bits of a level: values in a range, ranges in a group, groups in a group of groups.
LEVEL = 16
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _values(df: DataFrame, cols, digits: int) -> DataFrame:
    """metric (position of the column), units, range."""

    def units(c):
        number = F.col(c).cast("double")
        return whole_units(F.when(~F.isnan(number), F.col(c)), digits)

    pairs = [F.struct(F.lit(i).alias("metric"), units(c).alias("units")) for i, c in enumerate(cols)]
    values = df.select(F.inline(F.array(*pairs))).filter(F.col("units").isNotNull())
    return values.select("metric", "units", F.shiftright("units", LEVEL).alias("range"))


def _ranges(values: DataFrame) -> DataFrame:
    """Rows of each range, and their sums by place within the range, which stay small and whole."""
    place = F.col("units").bitwiseAND(F.lit((1 << LEVEL) - 1))
    return values.groupBy("metric", "range").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(place).alias("places"),
        # In two parts, so that plain integer sums are enough for any number of rows.
        F.sum(F.shiftright(place * place, LEVEL)).alias("squares_high"),
        F.sum((place * place).bitwiseAND(F.lit((1 << LEVEL) - 1))).alias("squares_low"),
        F.min("units").alias("min"),
        F.max("units").alias("max"),
    )


def _moments(ranges: DataFrame) -> DataFrame:
    """metric, n, total (whole units, exact), spread (sum of squared distances from the mean), min, max. Distances are
    taken from the whole part of the mean before they are squared, so nothing cancels."""
    start = F.col("range").cast("decimal(20,0)") * (1 << LEVEL)
    total = (start * F.col("rows") + F.col("places")).cast("decimal(38,0)")
    whole = ranges.groupBy("metric").agg(
        F.sum("rows").alias("n"), F.sum(total).alias("total"), F.min("min").alias("min"), F.max("max").alias("max")
    )
    whole = whole.withColumn("middle", F.floor(F.col("total") / F.col("n")).cast("bigint"))
    rows, places = F.col("rows").cast("double"), F.col("places").cast("decimal(19,0)")
    squares = F.col("squares_high").cast("decimal(20,0)") * (1 << LEVEL) + F.col("squares_low").cast("decimal(20,0)")
    inside = (squares * F.col("rows") - places * places).cast("double") / rows
    apart = (F.shiftleft("range", LEVEL) - F.col("middle")).cast("double") + places.cast("double") / rows
    # One row for each metric.
    spread = ranges.drop("min", "max").join(F.broadcast(whole), "metric").groupBy("metric", "n", "total", "min", "max").agg(
        F.sum(inside + rows * apart * apart).alias("_squares"), F.sum(rows * apart).alias("_sum")
    )
    centred = F.col("_squares") - F.col("_sum") * F.col("_sum") / F.col("n")
    return spread.withColumn("spread", F.greatest(centred, F.lit(0.0))).drop("_squares", "_sum")


def _targets(quantiles):
    """For each quantile of n values the two ranks (from 0) around it, weighted by where it lies between them."""
    targets = []
    for name, q in quantiles.items():
        spot = F.lit(float(q)) * (F.col("n") - 1)
        above = spot - F.floor(spot)
        for rank, weight in [(F.floor(spot), 1.0 - above), (F.floor(spot) + 1, above)]:
            # The upper rank does not exist for the largest value, which then has no weight either.
            rank = F.least(rank, F.col("n") - 1)
            targets.append(F.struct(F.lit(name).alias("quantile"), rank.alias("rank"), weight.alias("weight")))
    return F.array(*targets)


def _within(targets, before, upto):
    return F.filter(targets, lambda t: (t["rank"] >= before) & (t["rank"] < upto))


def _hit_ranges(ranges: DataFrame, quantiles) -> DataFrame:
    """metric, range, n, before: the ranges that hold a quantile, and how many values lie below them. Two for each
    quantile of each column at most, at every level."""
    found = ranges.groupBy("metric").agg(F.sum("rows").alias("n"))
    found = found.select("metric", F.lit(None).cast("bigint").alias("upper"), "n", F.lit(0).cast("bigint").alias("before"))
    for shift in (2 * LEVEL, LEVEL, 0):
        groups = ranges.groupBy("metric", F.shiftright("range", shift).alias("key")).agg(F.sum("rows").alias("rows"))
        same = groups["metric"] == found["metric"]
        if shift < 2 * LEVEL:
            same = same & (F.shiftright(groups["key"], LEVEL) == found["upper"])
        inside = groups.join(F.broadcast(found), same).select(
            groups["metric"], "key", "rows", "n", F.col("before").alias("below"), "upper"
        )
        order = Window.partitionBy("metric", "upper").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.col("below") + F.sum("rows").over(order)
        placed = inside.select("metric", "key", "n", "rows", (upto - F.col("rows")).alias("before"))
        hit = F.size(_within(_targets(quantiles), F.col("before"), F.col("before") + F.col("rows"))) > 0
        found = placed.filter(hit).select("metric", F.col("key").alias("upper"), "n", "before")
    return found.withColumnRenamed("upper", "range")


def _quantile_columns(values: DataFrame, ranges: DataFrame, quantiles, digits: int) -> DataFrame:
    """metric, and one column per quantile."""
    hit_ranges = F.broadcast(_hit_ranges(ranges, quantiles))
    counted = values.join(hit_ranges, ["metric", "range"]).groupBy("metric", "range", "before", "n", "units")
    counted = counted.agg(F.count(F.lit(1)).alias("rows"))
    inside = Window.partitionBy("metric", "range").orderBy("units").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("upto")
    hits = counted.withColumn("upto", F.col("before") + F.sum("rows").over(inside)).select(
        "metric", "n", "units", F.inline(_within(_targets(quantiles), upto - F.col("rows"), upto))
    )
    share = from_units(F.col("units"), digits) * F.col("weight")
    return hits.groupBy("metric").agg(*[F.sum(F.when(F.col("quantile") == q, share)).alias(q) for q in quantiles])


def _metric_name(cols):
    return F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("metric") + 1).alias("metric")


def exact_quantiles(df: DataFrame, cols, quantiles=None, digits: int = 2) -> DataFrame:
    """One row per column, one value per quantile: linear between the two neighbouring values. `digits`: decimals of the
    values."""
    quantiles = quantiles or QUARTILES
    values = _values(df, cols, digits)
    return _quantile_columns(values, _ranges(values), quantiles, digits).select(_metric_name(cols), *quantiles)


def median(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    return exact_quantiles(df, [col], {"q50": 0.5}, digits).select(F.col("q50").alias(col))


def describe(df: DataFrame, cols, digits: int = 2) -> DataFrame:
    """One row per column: count, mean, sample std, min, quartiles, max. `digits`: decimals of the values."""
    values = _values(df, cols, digits)
    ranges = _ranges(values)
    # Both have one row for each metric.
    rows = _moments(ranges).join(F.broadcast(_quantile_columns(values, ranges, QUARTILES, digits)), "metric")
    unit = float(10**digits)
    return rows.select(
        _metric_name(cols),
        F.col("n").alias("count"),
        (F.col("total").cast("double") / unit / F.col("n")).alias("mean"),
        (F.sqrt(F.try_divide(F.col("spread"), (F.col("n") - 1).cast("double"))) / unit).alias("std"),
        from_units(F.col("min"), digits).alias("min"),
        *QUARTILES,
        from_units(F.col("max"), digits).alias("max"),
    )
