"""Population statistics of traces and spots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.statistics import median
from tracemill.operators.joins import AXES, distance


def pair_distances(traces: DataFrame, copy: list[str], order: str, carried: list[str] | None = None) -> DataFrame:
    """Distances of all region pairs i < j of a copy; null where a place is missing. ``carried``: columns of the region i that come along."""
    carried = carried or []
    points = traces.select(*copy, F.struct(F.col(order).alias("o"), *AXES, *carried).alias("p"))
    pairs = points.withColumnRenamed("p", "l").join(points.withColumnRenamed("p", "r"), copy).where("l.o < r.o")
    return pairs.select(*copy, F.col("l.o").alias("i"), F.col("r.o").alias("j"), distance("l", "r").alias("d"), *[F.col(f"l.{c}").alias(c) for c in carried])


def contact(d: Column, threshold: float, op: str = "<=", nulls: str = "skip") -> Column:
    """Contact probability. op: <= or <, or <> (equal distances count on neither side); nulls: skip, or count as no contact."""
    hit = F.sum(F.when(d <= threshold if op == "<=" else d < threshold, 1).otherwise(0))
    all_ = F.count(F.lit(1)) if nulls == "no" else F.sum(F.when(d != threshold, 1).otherwise(0)) if op == "<>" else F.count(d)
    return hit / F.nullif(all_, F.lit(0))


STATISTICS = {"median": median, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "count": F.count}


def population_map(pairs: DataFrame, keys: list[str], threshold: float, statistics: tuple[str, ...] = ("median",)) -> DataFrame:
    """Per region pair: the named statistics of its distances over copies, the contact share, and the copies seen."""
    d = F.col("d")
    return pairs.groupBy(*keys, "i", "j").agg(*[STATISTICS[s](d).alias(s) for s in statistics], contact(d, threshold).alias("contact"), F.count("d").alias("n"))


def radius_of_gyration(traces: DataFrame, copy: list[str]) -> DataFrame:
    """Root of the mean squared distance to the mean place: var_pop summed over axes."""
    return traces.where("x is not null").groupBy(*copy).agg(F.sqrt(sum((F.var_pop(c) for c in AXES), F.lit(0.0))).alias("rg"), F.count(F.lit(1)).alias("n"))


def radius_about_median(traces: DataFrame, copy: list[str]) -> DataFrame:
    middle = traces.groupBy(*copy).agg(*[median(F.col(c)).alias(f"m{c}") for c in AXES])
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in AXES), F.lit(0.0)))
    return traces.join(middle, copy).groupBy(*copy).agg(F.avg(d).alias("rg_median"))


def centroids(traces: DataFrame, copy: list[str]) -> DataFrame:
    return traces.groupBy(*copy).agg(*[median(F.col(c)).alias(c) for c in AXES])


def densities(traces: DataFrame, cell: list[str], uid: str, label: str, sigma: float, normalize: bool = False, reach: float | None = None) -> DataFrame:
    """Per point the sum (or mean) of exp(-d^2 / 2 sigma^2) over the points of each label in its cell, itself excluded; ``reach`` as in
    ``compartments.side_densities``."""
    from tracemill.operators.compartments import side_densities

    return side_densities(traces, cell, uid, label, uid, sigma, normalize=normalize, reach=reach).withColumnRenamed(label, "label")


def density_overlap(densities_wide: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return densities_wide.groupBy(*keys).agg((F.sum(F.sqrt(F.col(a) * F.col(b))) / F.sqrt(F.sum(a) * F.sum(b))).alias("overlap"))


def winsorized(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Clip to two percentiles of the group, then scale to 0..1."""
    q = df.groupBy(*keys).agg(F.percentile(value, low).alias("_lo"), F.percentile(value, high).alias("_hi"))
    clipped = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    return df.join(q, keys).withColumn("scaled", (clipped - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).drop("_lo", "_hi")


def genomic_scaling(pairs: DataFrame, keys: list[str], genomic: str, value: str) -> DataFrame:
    """Least squares of ln(value) on ln(genomic distance)."""
    use = pairs.where(f"{genomic} > 0 and {value} > 0").select(*keys, F.log(genomic).alias("gx"), F.log(value).alias("gy"))
    return use.groupBy(*keys).agg(F.regr_slope("gy", "gx").alias("slope"), F.regr_intercept("gy", "gx").alias("intercept"), F.corr("gy", "gx").alias("r"))


def domain_contacts(pairs: DataFrame, domains: DataFrame, copy: list[str], threshold: float) -> DataFrame:
    """Per pair of domains (copy, domain, start, end): share of region pairs in contact; a missing distance is no contact."""
    a = domains.select(*copy, F.col("domain").alias("da"), F.col("start").alias("sa"), F.col("end").alias("ea"))
    b = domains.select(*copy, F.col("domain").alias("db"), F.col("start").alias("sb"), F.col("end").alias("eb"))
    inside = pairs.join(a, copy).where("i >= sa and i < ea").join(b, copy).where("j >= sb and j < eb")
    return inside.groupBy("da", "db").agg(F.avg(F.when(F.col("d") <= threshold, 1.0).otherwise(0.0)).alias("contact"), F.count(F.lit(1)).alias("n"))


def effect_size(pairs: DataFrame, keys: list[str], intra: Column, method: str = "median") -> DataFrame:
    """(centre of inter - centre of intra distances) / root of the mean of their spreads, not below 0."""
    p = pairs.where("d is not null").withColumn("_in", intra)
    middle = median if method == "median" else F.avg
    centre = p.groupBy(*keys, "_in").agg(middle(F.col("d")).alias("m"))
    spread = p.join(centre, [*keys, "_in"]).groupBy(*keys, "_in").agg(F.first("m").alias("m"), middle(F.pow(F.col("d") - F.col("m"), 2)).alias("v"))
    side = lambda x, c: F.max(F.when(F.col("_in") == x, F.col(c)))
    return spread.groupBy(*keys).agg(F.greatest(F.lit(0.0), (side(False, "m") - side(True, "m")) / F.sqrt((side(False, "v") + side(True, "v")) / 2)).alias("effect"))


def counts_wide(df: DataFrame, keys: list[str], pivot: str, values: list, base: DataFrame) -> DataFrame:
    """Counts per key and pivot value, zero where there are none; all keys of ``base``."""
    counts = df.groupBy(*keys).agg(*[F.sum(F.when(F.col(pivot) == v, 1).otherwise(0)).alias(str(v)) for v in values])
    return base.select(*keys).distinct().join(counts, keys, "left").fillna(0)
