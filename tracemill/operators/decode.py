"""Decoding barcoded spots: codebooks, candidate groups, scores and greedy selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.joins import AXES, buckets, dealt, distance, radius_join, radius_pairs


def melted(codebook: DataFrame, bits: list[str]) -> DataFrame:
    """A wide 0/1 codebook as rows (id, bit name) of its ones."""
    rest = [c for c in codebook.columns if c not in bits]
    return codebook.unpivot(rest, bits, "bit", "on").where(F.col("on") == 1).drop("on")


def valid_pairs(codes: DataFrame) -> DataFrame:
    """(bit_a < bit_b) -> region of every pair of bits of a code; the lowest region wins a pair that several have."""
    a, b = codes.select("region_id", F.col("bit").alias("bit_a")), codes.select("region_id", F.col("bit").alias("bit_b"))
    return a.join(b, "region_id").where("bit_a < bit_b").groupBy("bit_a", "bit_b").agg(F.min("region_id").alias("region_id"))


def invalid_pairs(codes: DataFrame) -> DataFrame:
    """Pairs of the codebook's bits that no code has."""
    bits = codes.select("bit").distinct()
    every = bits.select(F.col("bit").alias("bit_a")).join(bits.select(F.col("bit").alias("bit_b")), F.col("bit_a") < F.col("bit_b"))
    return every.join(valid_pairs(codes), ["bit_a", "bit_b"], "left_anti")


def candidate_pairs(spots: DataFrame, codes: DataFrame, radius: float, keys: list[str], uid: str = "uid") -> DataFrame:
    """Spot pairs within ``radius`` whose bits belong to a code: region, both spots, centre, distance, mean height, its
    coefficient of variation."""
    # a spot is listed with the bits that may join its own, so that spots meet by cell, bit and bucket: only valid pairs are measured
    valid = valid_pairs(codes)
    partners = valid.select(F.col("bit_a").alias("bit"), F.col("bit_b").alias("_need"), "region_id").unionAll(valid.select(F.col("bit_b").alias("bit"), F.col("bit_a").alias("_need"), "region_id"))
    left = spots.join(F.broadcast(partners), "bit")  # a codebook's bit pairs
    right = spots.withColumn("_need", F.col("bit"))
    pairs = radius_join(left, right, radius, [*keys, "_need"], F.col(f"l.{uid}") < F.col(f"r.{uid}"))
    pairs = pairs.withColumns({"bit_a": F.least("l.bit", "r.bit"), "bit_b": F.greatest("l.bit", "r.bit"), "region_id": F.col("l.region_id")})
    mean = (F.col("l.height") + F.col("r.height")) / 2
    return pairs.select(
        *[F.col(f"l.{k}").alias(k) for k in keys], "region_id", F.col(f"l.{uid}").alias("a"), F.col(f"r.{uid}").alias("b"), "bit_a", "bit_b", "distance",
        mean.alias("height"), (F.abs(F.col("l.height") - F.col("r.height")) / 2 / mean).alias("variation"), *[((F.col(f"l.{c}") + F.col(f"r.{c}")) / 2).alias(c) for c in AXES],
    )


def third_spots(pairs: DataFrame, spots: DataFrame, codes: DataFrame, radius: float, keys: list[str], uid: str = "uid") -> DataFrame:
    """Spots within ``radius`` of a pair's centre that carry the remaining bits of its region: pair columns and c. Both meet by bit and bucket, in which a spot stands 27 times and a
    pair, of which there are many more, once; what is found is not shuffled."""
    want = codes.select("region_id", F.col("bit").alias("need"))
    open_ = buckets(pairs.join(F.broadcast(want), "region_id").where("need <> bit_a and need <> bit_b").dropna(subset=list(AXES)), radius, False)
    at = [*keys, "need", *[f"_b{c}" for c in AXES]]
    s = buckets(spots.dropna(subset=list(AXES)).select(*keys, F.col("bit").alias("need"), F.col(uid).alias("_c"), *AXES), radius, True).select(*at, "_c", *[F.col(c).alias(f"_{c}") for c in AXES])
    far = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in AXES), F.lit(0.0)))
    near = dealt(open_, at).join(dealt(s, at), at).withColumn("to_centre", far)
    return near.where(F.col("to_centre") <= radius).select(*pairs.columns, F.col("_c").alias("c"), "to_centre")


def scored(groups: DataFrame, keys: list[str], greater: list[str], less: list[str]) -> DataFrame:
    """Sum of ln shares: for metrics where more is better the share at or below, else the share at or above; nulls add 0."""
    # a group is a cell's candidates; they are shuffled once, for all metrics
    score, out = F.lit(0.0), dealt(groups, keys)
    for metric in [*greater, *less]:
        by = Window.partitionBy(*keys, F.col(metric).isNull()).orderBy(F.col(metric) if metric in greater else F.col(metric).desc())
        score = score + F.when(F.col(metric).isNotNull(), F.log(F.cume_dist().over(by))).otherwise(0.0)
    return out.withColumn("score", score)


DIGITS = 9  # of scores that are compared; beyond, engines' logarithms differ


def _in_turn(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows of each group in one task, one after the other in the given order, with their number _k: what a kernel goes through by batches. A group in order is sorted by Spark,
    on disk if it must be, and never held in Python."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def greedy(pairs: DataFrame, keys: list[str], most: int = 1) -> DataFrame:
    """Take pairs by falling score (ties: lower a, then b) while each spot has been used less than ``most`` times.

    Sequential within a cell, so a kernel: it goes through a cell's pairs in that order and holds the spots that are used."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: dict[int, int] = {}
        for df in batches:
            rows = []
            for i, (k, a, b) in enumerate(zip(df["_k"].tolist(), df["a"].tolist(), df["b"].tolist(), strict=True)):
                if k == 1:
                    used = {}
                if used.get(a, 0) < most and used.get(b, 0) < most:
                    used[a] = used.get(a, 0) + 1
                    used[b] = used.get(b, 0) + 1
                    rows.append(i)
            yield df.iloc[rows].drop(columns="_k")

    return _in_turn(pairs, keys, [F.round("score", DIGITS).desc(), F.col("a"), F.col("b")]).mapInPandas(take, pairs.schema)


def greedy_triples(pairs: DataFrame, spots: DataFrame, codes: DataFrame, radius: float, keys: list[str], correct: bool = True, uid: str = "uid") -> DataFrame:
    """Complete codes of three bits: pairs by falling score (ties: lower a, then b) are extended by their best third spot (see ``third_spots``) that is still free
    (nearest to the centre, then lowest), each spot used once; then, if errors of one bit are corrected, pairs whose spots are still free stand alone.

    pairs: keys, region_id, a, b, score. Columns keys, region_id, a, b, c (null for pairs), score. A cell's spots come first and are held; its pairs go by in their order, and
    third spots are looked for only where both of a pair are free, so that no list of them is made."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    id_ = kind(spots, uid)
    schema = ", ".join([*[f"{k} {kind(pairs, k)}" for k in keys], f"region_id {kind(pairs, 'region_id')}, a {kind(pairs, 'a')}, b {kind(pairs, 'b')}, c {id_}, score double"])
    names = [*keys, "region_id", "a", "b", "c", "score"]
    code: dict = {}
    for r in codes.distinct().collect():  # a codebook
        code.setdefault(r["region_id"], []).append(r["bit"])
    region = kind(pairs, "region_id")
    held = spots.dropna(subset=list(AXES)).select(*keys, F.lit(0).alias("_p"), F.lit(None).cast("double").alias("score"), F.lit(None).cast(region).alias("region_id"), F.col(uid).alias("a"), F.col("bit").cast("bigint").alias("b"), *[F.col(c).cast("double").alias(c) for c in AXES])
    rows = held.unionByName(pairs.select(*keys, F.lit(1).alias("_p"), "score", "region_id", "a", F.col("b").cast("bigint").alias("b"), *[F.lit(None).cast("double").alias(c) for c in AXES]))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, bit, free, late, key = {}, {}, {}, [], ()

        def alone() -> list[tuple]:
            """Of the pairs without a third spot those that are still free."""
            out = []
            for r, a, b, s in late if correct else ():
                if a in place and b in place:
                    del place[a], place[b]
                    out.append((*key, r, a, b, None, s))
            return out

        def third(r, a: int, b: int):
            """The nearest free spot of the code's other bits about the centre of two."""
            (za, xa, ya), (zb, xb, yb) = place[a], place[b]
            best = None
            for need in code.get(r, ()):
                if need in (bit[a], bit[b]) or need not in free:
                    continue
                ids, xyz = free[need]
                if isinstance(xyz, list):
                    free[need] = ids, xyz = np.array(ids), np.array(xyz)
                d = np.round(np.sqrt((xyz[:, 0] - (za + zb) / 2) ** 2 + (xyz[:, 1] - (xa + xb) / 2) ** 2 + (xyz[:, 2] - (ya + yb) / 2) ** 2), DIGITS)
                for i in np.flatnonzero(d <= radius)[np.argsort(d[d <= radius], kind="stable")]:  # ids rise, so that the lowest is first among equals
                    c = int(ids[i])
                    if c in place:
                        best = min(best or (np.inf, 0), (float(d[i]), c))
                        break
                    if sum(x in place for x in ids[:64].tolist()) < 32:  # many are gone: keep those that are left
                        stay = np.array([x in place for x in ids.tolist()], bool)
                        free[need] = (ids[stay], xyz[stay])
                        if not stay.any():
                            del free[need]
                        return third(r, a, b)
            return best and best[1]

        for df in batches:
            out = []
            columns = [df[c].tolist() for c in ("_k", "_p", "score", "region_id", "a", "b", *AXES)]
            for i, (k, p, s, r, a, b, z, x, y) in enumerate(zip(*columns, strict=True)):
                if k == 1:
                    out += alone()
                    place, bit, free, late, key = {}, {}, {}, [], tuple(df[c].iloc[i] for c in keys)
                if not p:
                    place[a], bit[a] = (z, x, y), b
                    free.setdefault(b, ([], []))
                    free[b][0].append(a)
                    free[b][1].append((z, x, y))
                elif a in place and b in place:
                    c = third(r, a, b)
                    if c is None:
                        late.append((r, a, b, s))
                    else:
                        del place[a], place[b], place[c]
                        out.append((*key, r, a, b, c, s))
            yield pd.DataFrame(out, columns=names).astype({"c": "Int64"})
        yield pd.DataFrame(alone(), columns=names).astype({"c": "Int64"})

    return _in_turn(rows, keys, [F.col("_p"), F.round("score", DIGITS).desc(), F.col("a"), F.col("b")]).mapInPandas(take, schema)


def whole_codes(codes: DataFrame) -> DataFrame:
    """Three bits of a code (bit_a < bit_b < bit_c) of which every pair stands for its region; see ``valid_pairs``."""
    valid = valid_pairs(codes)
    side = lambda x, y: valid.select("region_id", F.col("bit_a").alias(f"bit_{x}"), F.col("bit_b").alias(f"bit_{y}"))
    return side("a", "b").join(side("a", "c"), ["region_id", "bit_a"]).join(side("b", "c"), ["region_id", "bit_b", "bit_c"]).select("region_id", "bit_a", "bit_b", "bit_c")


def completed(spots: DataFrame, codes: DataFrame, radius: float, keys: list[str], uid: str = "uid", copied: tuple[str, ...] = ()) -> DataFrame:
    """Every set of spots that carries all bits of a code of three, with each spot within ``radius`` of the others and of the centre of the other two: keys, region_id,
    a < b < c by id and, if columns are ``copied``, the members in that order (structs of id, place and those).

    A set is met once: spots of the first two bits by buckets, then those of the third by the bucket of the first. What follows the last join needs no shuffle."""
    whole = F.broadcast(whole_codes(codes))  # a codebook's
    place = spots.dropna(subset=[*keys, *AXES]).select(*keys, F.struct(*dict.fromkeys([uid, *AXES, *copied])).alias("s"), "bit")
    of = lambda x: place.join(whole.withColumnRenamed(f"bit_{x}", "bit"), "bit").select(*keys, "region_id", *([f"bit_{y}" for y in "abc" if y != x]), F.col("bit").alias(f"bit_{x}"), F.col("s").alias(x), *[F.col(f"s.{c}").alias(c) for c in AXES])
    by = [*keys, "region_id", "bit_a", "bit_b", "bit_c"]
    pairs = radius_join(of("a"), of("b"), radius, by).select(*[F.col(f"l.{k}").alias(k) for k in by], F.col("l.a").alias("a"), F.col("r.b").alias("b"), *[F.col(f"l.{c}").alias(c) for c in AXES])
    at = [*by, *[f"_b{c}" for c in AXES]]
    # few bytes, but much work: dealt to all tasks
    first = dealt(buckets(pairs, radius, False).select(*at, "a", "b"), at)
    third = dealt(buckets(of("c"), radius, True).select(*at, "c"), at)
    met = first.join(third, at)
    square = lambda u, v: F.sqrt(sum((F.pow(x - y, 2) for x, y in zip(u, v, strict=True)), F.lit(0.0)))
    spot = {x: [F.col(f"{x}.{c}") for c in AXES] for x in "abc"}
    for x, y in ("ac", "bc"):
        met = met.where(square(spot[x], spot[y]) <= radius)
    for x, y, z in ("abc", "acb", "bca"):
        met = met.where(square([(u + v) / 2 for u, v in zip(spot[x], spot[y], strict=True)], spot[z]) <= radius)
    members = met.select(*keys, "region_id", F.sort_array(F.array("a", "b", "c")).alias("members"))
    ids = [F.get("members", F.lit(k))[uid].alias(x) for k, x in enumerate("abc")]
    return members.select(*keys, "region_id", *ids, *(["members"] if copied else []))


def unused(spots: DataFrame, groups: DataFrame, uid: str = "uid") -> DataFrame:
    """Spots that are in no group."""
    used = groups.select(F.explode(F.array("a", "b")).alias(uid)).distinct()
    return spots.join(used, uid, "left_anti")


def suppressed(spots: DataFrame, radius: float, keys: list[str], uid: str = "uid", mode: str = "intended") -> DataFrame:
    """Drop spots that have a brighter spot within ``radius`` (mode intended), or any other spot (mode literal)."""
    pairs = radius_pairs(spots, radius, keys, uid)
    lower = F.when(F.col("l.height") < F.col("r.height"), F.array(F.col(f"l.{uid}"))).otherwise(F.array(F.col(f"r.{uid}")))
    both = F.array(F.col(f"l.{uid}"), F.col(f"r.{uid}"))
    return spots.join(pairs.select(F.explode(lower if mode == "intended" else both).alias(uid)).distinct(), uid, "left_anti")
