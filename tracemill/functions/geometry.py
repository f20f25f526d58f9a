"""Scalar transforms of coordinates and scores, as column expressions."""

from __future__ import annotations

from itertools import combinations_with_replacement
from math import cos, radians, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.joins import AXES


def positions(spots: DataFrame) -> DataFrame:
    """Pixels to nm by each row's own pixel sizes."""
    return spots.withColumns({c: F.col(c) * F.col(f"pixel_{c}") for c in AXES})


def microscope(spots: DataFrame, size: tuple[int, int], transpose: bool, flip_x: bool, flip_y: bool) -> DataFrame:
    """Swap x and y, then mirror axes about the image centre."""
    x, y = (F.col("y"), F.col("x")) if transpose else (F.col("x"), F.col("y"))
    return spots.withColumns({"x": size[0] - x if flip_x else x, "y": size[1] - y if flip_y else y})


def moved(spots: DataFrame, degrees: float, centre: tuple[float, float], drift: tuple[float, float, float]) -> DataFrame:
    """Rotate x, y about ``centre``, then subtract the drift (z, x, y)."""
    c, s = cos(radians(degrees)), sin(radians(degrees))
    dx, dy = F.col("x") - centre[0], F.col("y") - centre[1]
    return spots.withColumns({"z": F.col("z") - drift[0], "x": c * dx - s * dy + centre[0] - drift[1], "y": s * dx + c * dy + centre[1] - drift[2]})


def monomials(order: int, centre: tuple[float, float, float] = (0.0, 0.0, 0.0), scale: float = 1.0) -> list[Column]:
    """All products of up to ``order`` centred (and scaled) coordinates, by rising order, combinations with replacement."""
    base = [(F.col(c) - m) / scale if scale != 1 else F.col(c) - m for c, m in zip(AXES, centre, strict=True)]
    out = []
    for n in range(order + 1):
        for combination in combinations_with_replacement(base, n):
            e = F.lit(1.0)
            for x in combination:
                e = e * x
            out.append(e)
    return out


def chromatic(spots: DataFrame, constants: dict[str, list[float]], order: int, centre: tuple[float, float, float]) -> DataFrame:
    """Subtract from each axis its polynomial in the centred coordinates."""
    terms = monomials(order, centre)
    return spots.withColumns({c: F.col(c) - sum((F.lit(k) * t for k, t in zip(constants[c], terms, strict=True)), F.lit(0.0)) for c in AXES})


def centred(df: DataFrame, keys: list[str], scale: bool = False) -> DataFrame:
    """Subtract the mean place of the group; with ``scale`` also divide by the root of the total variance."""
    by = Window.partitionBy(*keys)
    total = F.sqrt(sum((F.var_pop(c).over(by) for c in AXES), F.lit(0.0))) if scale else F.lit(1.0)
    return df.withColumns({c: (F.col(c) - F.avg(c).over(by)) / total for c in AXES})


def normalised(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Values over the mean of their keys, which an aggregate finds: a few keys (channels) do not put the table into as few tasks."""
    return df.join(df.groupBy(*keys).agg(F.avg(value).alias("_mean")), keys).withColumn(value, F.col(value) / F.col("_mean")).select(*df.columns)


def log_distance_score(d: Column, ref: float = 2000.0) -> Column:
    return F.log(d / ref + 1)


def exp_distance_score(d: Column, ref: float = 2000.0) -> Column:
    return -F.exp(d / ref)


def linear_scores(d: Column, height: Column, ref_d: float, ref_h: float, w_d: float = 1.0, w_h: float = 1.0) -> Column:
    return -w_d * d / ref_d + w_h * F.log(height / (height + ref_h))


def box_overlap(a: str, b: str, axes: tuple[str, ...] = AXES) -> Column:
    """Volume of the overlap of boxes with <axis>_min and <axis>_max columns, 0 if apart."""
    sides = [F.greatest(F.lit(0.0), F.least(f"{a}.{c}_max", f"{b}.{c}_max") - F.greatest(f"{a}.{c}_min", f"{b}.{c}_min")) for c in axes]
    out = F.lit(1.0)
    for s in sides:
        out = out * s
    return out
