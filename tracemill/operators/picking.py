"""Choosing spots for chromosome copies."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def brightest(spots: DataFrame, keys: list[str], uid: str = "uid") -> DataFrame:
    """The brightest candidate of each region (lowest uid on ties)."""
    best = F.max(F.struct(F.col("height"), (-F.col(uid)).alias("_u"), F.struct(*spots.columns).alias("row"))).alias("best")
    return spots.groupBy(*keys).agg(best).select("best.row.*")


def pair_assignment(candidates: DataFrame, keys: list[str], uid: str, s0: Column, s1: Column) -> DataFrame:
    """Two copies, one candidate each: the two different candidates with the greatest sum of scores; a single candidate
    goes to the copy that scores it higher. Columns keys, copy0, copy1, total.

    Only candidates meet that can be of the best pair: those whose score, with the greatest other score of the group, reaches the total of some pair; of equal scores
    the two lowest ids, as ties go to them."""
    c = candidates.select(*keys, F.col(uid).alias("u"), s0.alias("s0"), s1.alias("s1"))
    # the best candidate of one copy with the best other one of the other
    first = c.groupBy(*keys).agg(F.max(F.struct("s0", "u")).alias("m0"), F.max(F.struct("s1", "u")).alias("m1")).withColumnsRenamed({k: f"_k{k}" for k in keys})
    on = [F.col(k) == F.col(f"_k{k}") for k in keys]
    known = c.join(first, on).groupBy(*keys).agg(F.first("m0.s0").alias("_top0"), F.first("m1.s1").alias("_top1"), F.greatest(F.max(F.when(F.col("u") != F.col("m0.u"), F.col("m0.s0") + F.col("s1"))), F.max(F.when(F.col("u") != F.col("m1.u"), F.col("s0") + F.col("m1.s1")))).alias("_least"))
    # where no total is known, the lowest ids are taken
    low = lambda s: F.row_number().over(Window.partitionBy(*keys, F.when(F.col("_least").isNotNull(), F.col(s))).orderBy("u")) <= 2
    able = c.join(known, keys)
    left = able.where("_least is null or s0 + _top1 >= _least").select(*keys, "u", "s0", low("s0").alias("_ok")).where("_ok").drop("_ok")
    right = able.where("_least is null or _top0 + s1 >= _least").select(*keys, "u", "s1", low("s1").alias("_ok")).where("_ok").drop("_ok")
    both = left.alias("a").join(right.alias("b"), keys).where("a.u <> b.u").groupBy(*keys).agg(F.max(F.struct((F.col("a.s0") + F.col("b.s1")).alias("total"), (-F.col("a.u")).alias("x"), (-F.col("b.u")).alias("y"))).alias("m"))
    single = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("u").alias("u"), F.first("s0").alias("s0"), F.first("s1").alias("s1")).where("n = 1")
    one = single.select(*keys, F.when(F.col("s0") >= F.col("s1"), F.col("u")).alias("copy0"), F.when(F.col("s0") < F.col("s1"), F.col("u")).alias("copy1"), F.greatest("s0", "s1").alias("total"))
    return both.select(*keys, (-F.col("m.x")).alias("copy0"), (-F.col("m.y")).alias("copy1"), F.col("m.total").alias("total")).unionByName(one)


def filter_by_score(picked: DataFrame, score: str, weights: float, share: float = 0.05) -> DataFrame:
    """Null the pick whose score is below ``weights * ln(share)``."""
    return picked.withColumn("kept", F.col(score) >= weights * float(np.log(share)))


def lloyd(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Weighted k-means labels, from the farthest-first start at the heaviest point."""
    if not k or not len(points):
        return np.zeros(len(points), int)
    start = [int(np.argmax(weights))]
    while len(start) < min(k, len(points)):
        d = np.min([((points - points[i]) ** 2).sum(1) for i in start], axis=0)
        start.append(int(np.argmax(d)))
    centres = points[start]
    labels = np.zeros(len(points), int)
    for _ in range(rounds):
        new = np.argmin(((points[:, None] - centres[None]) ** 2).sum(2), axis=1)
        if _ and (new == labels).all():
            break
        labels = new
        for c in range(len(centres)):
            own = labels == c
            if own.any():
                centres[c] = np.average(points[own], axis=0, weights=weights[own])
    return labels


def viterbi(scores: list[np.ndarray], places: list[np.ndarray], orders: np.ndarray, weight: float = 1.0, ref: float = 1000.0) -> list[int]:
    """One candidate for each region of a copy: the path with the greatest sum of scores less weight * distance / ref over the step's
    order gap. Ties go to the earlier candidate."""
    best, back = [scores[0]], []
    for k in range(1, len(scores)):
        gap = max(float(orders[k] - orders[k - 1]), 1.0)
        d = np.sqrt(((places[k][:, None] - places[k - 1][None]) ** 2).sum(2))
        way = best[-1][None] - weight * d / ref / gap
        back.append(way.argmax(1))
        best.append(scores[k] + way.max(1))
    at = int(best[-1].argmax())
    path = [at]
    for b in reversed(back):
        at = int(b[at])
        path.append(at)
    return path[::-1]


def dynamic_pick(candidates: DataFrame, keys: list[str], order: str, uid: str = "uid", weight: float = 1.0, ref: float = 1000.0) -> DataFrame:
    """Viterbi picks per copy. A group is one copy's candidates (uid, order, score, z, x, y); regions go by order."""

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        df = df.dropna(subset=["z", "x", "y", "score"]).sort_values([order, uid])
        if df.empty:
            return df
        groups = [g for _, g in df.groupby(order, sort=True)]
        path = viterbi([g["score"].to_numpy() for g in groups], [g[["z", "x", "y"]].to_numpy() for g in groups], np.array([g[order].iloc[0] for g in groups]), weight, ref)
        return pd.concat([g.iloc[[i]] for g, i in zip(groups, path, strict=True)])

    return candidates.groupBy(*keys).applyInPandas(pick, candidates.schema)


def _share(values: np.ndarray, refs: np.ndarray, greater: bool) -> np.ndarray:
    """Smoothed ln share of the references at or below (or at or above) each value."""
    refs = np.sort(refs[~np.isnan(refs)])
    n = len(refs)
    below = np.searchsorted(refs, values, side="right")
    f = (below + 1) / (n + 2) if greater else 1 - (below + 1) / (n + 2)
    return np.where(np.isnan(values), 0.0, np.log(np.clip(f, 1e-12, None)))


def iterative_pick(spots: DataFrame, cell: list[str], copies: int = 2, rounds: int = 10, shrink: float = 0.8, weights: tuple[float, float] = (1.0, 2.0), uid: str = "uid") -> DataFrame:
    """Pick one spot for each region and copy of each chromosome of a cell.

    Columns: cell, chr, region, uid, height, z, x, y. Start: k-means with weight 1 / candidates of the region. Then, until at most a
    hundredth of the picks change: shares of height and of the distance to the copy's centre among all spots of the cell give scores, each
    region's candidates go to the copies with the greatest total, and centres move ``shrink`` of the way. A group is one cell.
    """
    schema = T.StructType([*[spots.schema[c] for c in cell], spots.schema["chr"], spots.schema["region"], T.StructField("copy", T.IntegerType()), T.StructField("uid", spots.schema[uid].dataType), T.StructField("score", T.DoubleType())])

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        df = df.dropna(subset=["z", "x", "y", "height"]).sort_values(["chr", "region", uid]).reset_index(drop=True)
        if df.empty or not copies:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        xyz = df[["z", "x", "y"]].to_numpy(float)
        centres = {}
        for c, g in df.groupby("chr"):
            w = 1 / g.groupby("region")[uid].transform("count").to_numpy(float)
            labels = lloyd(xyz[g.index], w, copies)
            whole = np.average(xyz[g.index], axis=0, weights=w)
            centres[c] = np.array([np.average(xyz[g.index][labels == k], axis=0, weights=w[labels == k]) if (labels == k).any() else whole for k in range(copies)])
        bright = _share(df["height"].to_numpy(float), df["height"].to_numpy(float), True) * weights[0]
        regions = [(c, g.index.to_numpy()) for (c, _), g in df.groupby(["chr", "region"], sort=True)]
        picks: dict[int, tuple] = {}
        for _ in range(rounds):
            d = np.stack([np.sqrt(((xyz - np.array([centres[c][k] for c in df["chr"]])) ** 2).sum(1)) for k in range(copies)], 1)
            score = bright[:, None] + weights[1] * np.stack([_share(d[:, k], d.ravel(), False) for k in range(copies)], 1)
            new = {}
            for r, (_, at) in enumerate(regions):
                padded = [*at.tolist(), *[-1] * max(0, copies - len(at))]
                top = sorted({i for k in range(copies) for i in sorted(padded, key=lambda i: (-score[i, k] if i >= 0 else np.inf, i))[:copies]})
                options = permutations([*top, *[-1] * max(0, copies - len(top))], copies)
                new[r] = max(options, key=lambda o: (sum(o_ >= 0 for o_ in o), sum(score[i, k] for k, i in enumerate(o) if i >= 0), tuple(-i for i in o)))
            changed = sum(picks.get(r) != new[r] for r in new)
            picks = new
            for c in centres:
                for k in range(copies):
                    own = [picks[r][k] for r, (chrom, _) in enumerate(regions) if chrom == c and picks[r][k] >= 0]
                    if own:
                        centres[c][k] += shrink * (np.median(xyz[own], axis=0) - centres[c][k])
            if changed <= 0.01 * len(new):
                break
        rows = [(df.loc[at[0], "region"], df.loc[at[0], "chr"], k, i) for r, (_, at) in enumerate(regions) for k, i in enumerate(picks[r]) if i >= 0]
        out = pd.DataFrame({"chr": [x[1] for x in rows], "region": [x[0] for x in rows], "copy": [x[2] for x in rows], "uid": [df.loc[x[3], uid] for x in rows], "score": [float(score[x[3], x[2]]) for x in rows]})
        for c in cell:
            out[c] = df[c].iloc[0]
        return out[[f.name for f in schema.fields]]

    return spots.groupBy(*cell).applyInPandas(pick, schema)
