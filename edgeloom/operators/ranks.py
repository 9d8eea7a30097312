"""Medians and modes of groups of any size: no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import place

#: So many ranges at quantiles of the value; the middle of a group is looked for in the range that holds it.
RANGES = 256


def _counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): how often each value occurs, counted before the shuffle and after it."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))


def mode(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the most frequent value, of equally frequent ones the smallest. Groups without values aren't listed."""
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v")))
    return _counts(df, keys, value).groupBy(*keys).agg(best.alias("__b")).select(*keys, F.col("__b.v").alias(name))


def median(df: DataFrame, keys: list[str], value: str, name: str, ranges: int = RANGES) -> DataFrame:
    """(keys, name): the middle value (the mean of the two middle ones) of a number column. Groups without values aren't listed.

    Counts of each group's ranges give the ranges with its middle ranks; values are ordered within those only.
    """
    found = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    counts = _counts(df, keys, value).withColumn("__r", place(F.col(value), sorted(set(found or []))))
    in_order, whole = Window.partitionBy(*keys).orderBy("__r"), Window.partitionBy(*keys)
    sums = counts.groupBy(*keys, "__r").agg(F.sum("__n").alias("__m"))
    sums = sums.withColumns({"__before": F.sum("__m").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__m"), "__all": F.sum("__m").over(whole)})
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)  # ranks from 0
    sums = sums.filter((F.col("__before") <= high) & (F.col("__before") + F.col("__m") > low))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] + [F.col("c.__r") == F.col("s.__r")]
    near = counts.alias("c").join(sums.alias("s"), same).select("c.*", "s.__before", "s.__all")
    inside = Window.partitionBy(*keys, "__r").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("__end", F.col("__before") + F.sum("__n").over(inside))
    holds = lambda rank: (F.col("__end") > rank) & (F.col("__end") - F.col("__n") <= rank)
    ends = near.groupBy(*keys).agg(F.max(F.when(holds(low), F.col(value))).alias("__low"), F.max(F.when(holds(high), F.col(value))).alias("__high"))
    return ends.select(*keys, ((F.col("__low") + F.col("__high")) / 2).alias(name))
