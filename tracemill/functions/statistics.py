"""Aggregates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(d: Column) -> Column:
    """The exact median of the group's values, null for none, of groups that fit in a task (a pair of regions over all copies, a copy). Values are
    gathered and sorted as plain numbers, which takes a fraction of the time of the map of counts behind ``percentile``."""
    values = F.sort_array(F.collect_list(d.cast("double")))
    n = F.size(values)
    return F.when(n > 0, (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2)


def medians(df: DataFrame, keys: list[str], value: str, whole: int = 100_000) -> DataFrame:
    """The exact median (null for none) and the number of values of a few groups of any size: keys, median, n.

    The middle of a group of more than ``whole`` values lies between two quantiles of a sketch, each ten times the sketch's error away from it. Values below are counted,
    those between are counted by value and put in order, those above are left out, so that the frame is read twice and hardly anything of it is shuffled."""
    by = [f"_k{k}" for k in keys]
    d = df.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], F.col(value).cast("double").alias("_v"))
    limits = d.groupBy(*by).agg(F.percentile_approx("_v", [0.499, 0.501], 10000).alias("_q"), F.count("_v").alias("n")).withColumnsRenamed(dict(zip(by, keys, strict=True)))
    at = lambda k, end: F.when(F.col("n") > whole, F.get("_q", F.lit(k))).otherwise(F.lit(float(end)))
    limits = limits.select(*keys, "n", at(0, "-inf").alias("_lo"), at(1, "inf").alias("_hi"))
    on = [F.col(b).eqNullSafe(F.col(k)) for k, b in zip(keys, by, strict=True)]
    near = d.join(F.broadcast(limits), on).where("_v <= _hi").select(*keys, "n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
    held = near.groupBy(*keys, "n", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = held.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))  # null, those below, comes first
    rank = lambda k: F.min(F.when(F.col("_upto") > F.floor((F.col("n") - k) / 2), F.col("_v")))
    middle = upto.groupBy(*keys).agg(((rank(1) + rank(0)) / 2).alias("median")).withColumnsRenamed(dict(zip(keys, by, strict=True)))
    got = F.when(F.col("n") > 0, F.coalesce("median", F.raise_error(F.lit("the middle is not where the sketch has it")).cast("double")))
    return limits.join(F.broadcast(middle), on, "left").select(*keys, got.alias("median"), "n")
