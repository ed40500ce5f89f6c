"""Ranks inside groups without ever sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def magnitude_bin(value: Column, per_unit: int = 64) -> Column:
    """A monotone bin number of any double: equal values share a bin, larger values never get a smaller bin.

    per_unit bins for every power of two, from the smallest double to the largest, so scores of any unit spread over
    them alike: the exponent counts powers, the mantissa places within one. Zeros have bin 0, infinities the outermost ones.
    """
    size = F.abs(value)
    power = F.floor(F.log2(size))
    # where log2 is a hair off at a power of two, the mantissa makes up for it
    place = (power + 1100) * per_unit + F.floor((size / F.pow(F.lit(2.0), power) - 1) * per_unit)
    inside = F.when(size == float("inf"), F.lit(3000 * per_unit)).otherwise(place)
    return F.when(size == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * inside).cast("long")


def standing_of_values(df: DataFrame, keys: list[str], value: str, per_unit: int = 4096) -> DataFrame:
    """(keys, value, n_lower, n_equal): how many rows of the group lie below each distinct value, and on it.

    Rows are counted per value and per bin first (both combine before the shuffle); the running sum over
    values is taken inside one bin, the running sum over bins inside one group. A group with a third of all
    rows is therefore spread over its bins, and equal values are one counted row.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_equal")).withColumn("_bin", magnitude_bin(F.col(value), per_unit))
    before = W.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inside = counts.withColumn("_in", F.coalesce(F.sum("n_equal").over(before), F.lit(0)))
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("n_equal").alias("_n"))
    over = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(*keys, "_bin", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_below"))
    return inside.join(bins, [*keys, "_bin"]).select(*keys, value, (F.col("_in") + F.col("_below")).alias("n_lower"), "n_equal")
