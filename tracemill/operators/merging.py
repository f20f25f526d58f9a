"""Combining tables of spots, cells and masks."""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.joins import AXES


def recombined(spots: DataFrame, repeats: DataFrame, keys: list[str]) -> DataFrame:
    """Spots of a region that was imaged again come from the repeat alone."""
    return spots.join(repeats.select(*keys).distinct(), keys, "left_anti").unionByName(repeats)


def paired_cells(dna: DataFrame, rna: DataFrame, pairs: DataFrame, prefix: str = "rna_") -> DataFrame:
    """Attributes of matched cells side by side: pairs (rna_cell, dna_cell); a cell with several partners is left out."""
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    once = pairs.distinct().withColumns({"_a": n("rna_cell"), "_b": n("dna_cell")}).where("_a = 1 and _b = 1").drop("_a", "_b")
    renamed = rna.withColumnsRenamed({c: prefix + c for c in rna.columns})
    return once.join(dna, F.col("dna_cell") == F.col("cell_id")).join(renamed, F.col("rna_cell") == F.col(f"{prefix}cell_id")).drop("rna_cell", "dna_cell")


def near_reference(candidates: DataFrame, references: DataFrame, keys: list[str], most: float, keep_without: bool = True) -> DataFrame:
    """Candidates at most ``most`` from the reference of the same keys; those without one stay if asked."""
    ref = references.select(*keys, *[F.col(c).alias(f"_{c}") for c in AXES], F.lit(True).alias("_has"))
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in AXES), F.lit(0.0)))
    keep = F.when(F.col("_has"), F.coalesce(d <= most, F.lit(False))).otherwise(F.lit(keep_without))
    return candidates.join(ref, keys, "left").where(keep).drop("_has", *[f"_{c}" for c in AXES])


def labels_of(spots: DataFrame, voxels: DataFrame, uid: str, radius: int = 1) -> DataFrame:
    """The most frequent non-zero label in the cube of ``radius`` around a spot (the smaller on ties), -1 without any.

    spots: uid, z, x, y (pixels); voxels: z, x, y, label. Voxels are counted by place and label, their counts are added up over the cubes, and each place of the image has
    its label before a spot asks for it."""
    held = voxels.where("label <> 0").groupBy(*AXES, "label").agg(F.count(F.lit(1)).alias("n"))
    for c in AXES:
        held = held.withColumn("_d", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn(c, F.col(c) + F.col("_d")).groupBy(*AXES, "label").agg(F.sum("n").alias("n"))
    best = held.groupBy(*AXES).agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b")).select(*[F.col(c).alias(f"_{c}") for c in AXES], (-F.col("b.l")).alias("label"))
    at = spots.select(uid, *[F.round(c).cast("int").alias(f"_{c}") for c in AXES])
    return at.join(best, [f"_{c}" for c in AXES], "left").select(uid, F.coalesce("label", F.lit(-1)).alias("label"))


def cell_locations(voxels: DataFrame, fov: str, centre: tuple[float, float, float], pixel: tuple[float, float, float]) -> DataFrame:
    """Per label of a mask: voxels, centre and bounding box, relative to the image centre and in the pixel's unit."""
    of = lambda e, k: (e - centre[k]) * pixel[k]
    columns = [F.count(F.lit(1)).alias("volume")]
    for k, c in enumerate(AXES):
        columns += [of(F.avg(c), k).alias(f"center_{c}"), of(F.min(c), k).alias(f"min_{c}"), of(F.max(c) + 1, k).alias(f"max_{c}")]
    return voxels.where("label > 0").groupBy(fov, "label").agg(*columns)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Share of each predicted label among the rows of each true label."""
    n = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth))).drop("n")


def intensity_flags(df: DataFrame, channel: str, uid: str, value: str, dimmest: int = 5, on: float = 4.753424, off: float = 2.326348) -> DataFrame:
    """Flags by a one-sided normal test against the background of the channel's ``dimmest`` ids by median.

    on and off are the z values of p = 1e-6 and p = 0.01: above on 1, at or below off -1, else 0."""
    medians = df.groupBy(channel, uid).agg(F.percentile(value, 0.5).alias("_m"))
    # one row for each id, not for each spot
    low = medians.withColumn("_n", F.row_number().over(Window.partitionBy(channel).orderBy("_m", uid))).where(F.col("_n") <= dimmest).select(channel, uid)
    back = df.join(low, [channel, uid]).groupBy(channel).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    z = (F.col(value) - F.col("_mean")) / F.nullif("_std", F.lit(0.0))
    return df.join(back, channel).withColumn("flag", F.when(z > on, 1).when(z <= off, -1).otherwise(0)).drop("_mean", "_std")


def cloud(points: DataFrame, keys: list[str], sigma: float, reach: int = 2) -> DataFrame:
    """Sum of Gaussians of points on the integer grid, out to ``reach`` voxels of each point's voxel."""
    out = points.dropna(subset=list(AXES)).select(*keys, *[F.col(c).alias(f"_{c}") for c in AXES])
    for c in AXES:
        out = out.withColumn(c, F.explode(F.sequence(F.round(f"_{c}").cast("int") - reach, F.round(f"_{c}").cast("int") + reach)))
    d2 = sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in AXES), F.lit(0.0))
    return out.groupBy(*keys, *AXES).agg(F.sum(F.exp(-d2 / (2 * sigma * sigma))).alias("density"))


#: The shares of Poisson(1) up to 0, 1, ..., 7.
POISSON = [sum(2.718281828459045**-1 / factorial(j) for j in range(k + 1)) for k in range(8)]
PRIME = 2147483647


def bootstrap(df: DataFrame, keys: list[str], value: str, uid: str, replicates: int = 100, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean under Poisson resampling, seeded by ``uid`` and replicate: a row's weight in a replicate depends on
    nothing else, so any partitioning gives the same interval. Three numbers from an id's digest give all its replicates' numbers, as
    a polynomial modulo a prime; weights are added up per replicate before anything is shuffled."""
    digest = F.md5(F.col(uid).cast("string"))
    part = lambda k: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") % PRIME
    rep = F.col("replicate").cast("long")
    u = ((F.col("_h0") + rep * F.col("_h1") + rep * rep * F.col("_h2")) % PRIME) / F.lit(float(PRIME))
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    drawn = df.where(F.col(value).isNotNull()).select(*keys, value, *[part(k).alias(f"_h{k}") for k in range(3)])
    drawn = drawn.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight)
    means = drawn.groupBy(*keys, "replicate").agg((F.sum(F.col(value) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
