"""Helpers on arrays and maps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sections(values: Column, starts: Column) -> Column:
    """An array cut at the given starts (ascending, from 0): an array of arrays, the last one to the end."""
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(values)))
    return F.zip_with(starts, ends, lambda a, b: F.slice(values, a + 1, b - a))


def parts_of(values: Column, labels: Column) -> Column:
    """A map from each label to the values that carry it (both arrays of one length)."""
    pairs = F.arrays_zip(values.alias("v"), labels.alias("l"))
    return F.map_from_entries(F.transform(F.array_distinct(labels), lambda k: F.struct(k, F.transform(F.filter(pairs, lambda p: p["l"] == k), lambda p: p["v"]))))


def bits_row(bits: Column, n: int) -> Column:
    """0/1 for each of n bits (from 0): whether it is in the array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array_contains(bits, k).cast("int"))


def default(values: Column, key: Column, otherwise: Column) -> Column:
    """A map's value, or a default: 0, -1, NaN or an empty array."""
    return F.coalesce(F.try_element_at(values, key), otherwise)


def closest_overlap(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """For each interval the greatest overlap with another of its group that begins next to it in order, or the least gap as a negative number: the neighbours
    by start decide. Columns of ``intervals`` and overlap."""
    from pyspark.sql import Window

    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.least("end", F.lag("end").over(by)) - F.col("start")
    after = F.least("end", F.lead("end").over(by)) - F.lead("start").over(by)
    return intervals.withColumn("overlap", F.greatest(before, after))
