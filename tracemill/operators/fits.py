"""Least-squares fits whose sums Spark adds up; only the small systems are solved in Python, or not at all."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.geometry import monomials


def polynomial(df: DataFrame, keys: list[str], target: Column, order: int, centre: tuple[float, float, float] = (0.0, 0.0, 0.0), scale: float = 1.0) -> DataFrame:
    """Per group the coefficients of ``target`` on the products of up to ``order`` centred coordinates (in the order of ``monomials``), R^2 and n.

    The products' sums are one aggregate; a group's normal equations, at most a few dozen numbers, are solved in a kernel.
    """
    terms = [t for t in monomials(order, centre, scale)]
    k = len(terms)
    use = df.select(*keys, F.array(*terms).alias("t"), target.alias("y")).where("y is not null and t[1] is not null")
    cross = [F.sum(F.get("t", F.lit(i)) * F.get("t", F.lit(j))) for i in range(k) for j in range(i, k)]
    right = [F.sum(F.get("t", F.lit(i)) * F.col("y")) for i in range(k)]
    sums = use.groupBy(*keys).agg(F.array(*cross).alias("a"), F.array(*right).alias("b"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    schema = ", ".join([*[f"{c} {df.schema[c].dataType.simpleString()}" for c in keys], "coefficients array<double>", "r2 double", "n long"])

    def solve(batches):
        for g in batches:
            rows = []
            for r in g.itertuples(index=False):
                a = np.zeros((k, k))
                a[np.triu_indices(k)] = r.a
                a = a + np.triu(a, 1).T
                b = np.array(r.b)
                x, *_ = np.linalg.lstsq(a, b, rcond=None)
                total = r.yy - r.y * r.y / r.n
                left = r.yy - 2 * x @ b + x @ a @ x
                rows.append((*[getattr(r, c) for c in keys], x.tolist(), float(1 - left / total) if total > 0 else float("nan"), int(r.n)))
            yield pd.DataFrame(rows, columns=[*keys, "coefficients", "r2", "n"])

    return sums.mapInPandas(solve, schema)


def bleed_slopes(pairs: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """Per place the line of the target channel's pixels on the source channel's: slope, intercept, r2, n."""
    use = pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    return use.groupBy(*keys).agg(F.regr_slope(target, source).alias("slope"), F.regr_intercept(target, source).alias("intercept"), F.regr_r2(target, source).alias("r2"), F.count(F.lit(1)).alias("n"))
