"""Spot groups, their tables, look-ups and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.joins import AXES, distance, radius_join


#: Columns of spots that groups carry.
COPIED = ("bit", "channel", "height", *AXES)


def wide(groups: DataFrame, spots: DataFrame, members: list[str], uid: str = "uid", copied: tuple[str, ...] = COPIED) -> DataFrame:
    """One row a group with the columns of its members side by side, <column>_0, <column>_1, ..., and centre, mean height, its coefficient of
    variation and the median distance of its spots. ``members``: the columns of ``groups`` that hold spot ids; null ones are absent."""
    out = groups
    for k, m in enumerate(members):
        side = spots.select(F.col(uid).alias(m), *[F.col(c).alias(f"{c}_{k}") for c in copied])
        out = out.join(side, m, "left")
    return described(out, [F.struct(*[F.col(f"{c}_{k}").alias(c) for c in (*AXES, "height")]) for k in range(len(members))])


def described(groups: DataFrame, spots: list[Column]) -> DataFrame:
    """Add center_<axis>, center_intensity, center_intensity_var (population CoV) and center_internal_dist (median) of some spot structs;
    spots without a place are left out."""
    there = [s["x"].isNotNull() for s in spots]
    n = sum((x.cast("int") for x in there), F.lit(0))
    mean = lambda values: sum((F.when(x, v).otherwise(0.0) for x, v in zip(there, values, strict=True)), F.lit(0.0)) / F.nullif(n, F.lit(0))
    out = groups.withColumns({f"center_{c}": mean([s[c] for s in spots]) for c in AXES} | {"center_intensity": mean([s["height"] for s in spots])})
    square = mean([(s["height"] - F.col("center_intensity")) * (s["height"] - F.col("center_intensity")) for s in spots])
    apart = lambda a, b: F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in AXES), F.lit(0.0)))
    pairs = [F.when(there[i] & there[j], apart(spots[i], spots[j])) for i in range(len(spots)) for j in range(i + 1, len(spots))]
    out = out.withColumn("center_intensity_var", F.sqrt(square) / F.col("center_intensity")).withColumn("_d", F.sort_array(F.array_compact(F.array(*pairs))) if pairs else F.array().cast("array<double>"))
    n = F.size("_d")
    middle = (F.get("_d", F.floor((n - 1) / 2).cast("int")) + F.get("_d", F.floor(n / 2).cast("int"))) / 2
    return out.withColumn("center_internal_dist", F.when(n > 0, middle)).drop("_d")


def long(groups: DataFrame, count: int, copied: tuple[str, ...] = COPIED) -> DataFrame:
    """Back from ``wide``: a row for each member that has a place, with its number in the group."""
    rest = [c for c in groups.columns if c not in {f"{x}_{k}" for x in copied for k in range(count)}]
    each = F.array(*[F.struct(F.lit(k).alias("member"), *[F.col(f"{c}_{k}").alias(c) for c in copied]) for k in range(count)])
    return groups.select(*rest, F.inline(F.filter(each, lambda s: s["x"].isNotNull())))


def of_cells(spots: DataFrame, cells: DataFrame, keys: list[str], uid: str = "cell_uid", outside: bool = False) -> DataFrame:
    """Spots with the uid of their cell. Those with a null or non-positive cell_id go, unless ``outside``."""
    inside = spots if outside else spots.where("cell_id > 0")
    return inside.join(cells.select(*keys, uid).dropDuplicates(keys), keys, "left")


def mixed_pixels(spots: DataFrame, keys: list[str]) -> DataFrame:
    """The groups whose rows do not agree in one pixel size: their keys and the sizes they have."""
    size = F.struct(*[F.col(f"pixel_{c}").alias(c) for c in AXES])
    return spots.groupBy(*keys).agg(F.count_distinct(size).alias("sizes")).where("sizes > 1")


def merged_rounds(tables: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def located(groups: DataFrame, regions: DataFrame, key: str = "region_id") -> DataFrame:
    """Groups with the chromosome, its order of the region (by midpoint, from 0), start, end and copy number."""
    by = Window.partitionBy("chr").orderBy((F.col("start") + F.col("end")) / 2, key)
    order = regions.withColumn("chr_order", (F.row_number().over(by) - 1).cast("int"))
    return groups.join(order.select(key, "chr", "chr_order", "start", "end"), key, "left")


def copy_numbers(regions: DataFrame, chromosomes: DataFrame, default: int = 2, key: str = "region_id") -> DataFrame:
    """Each region's copy number, by its chromosome; ``default`` where that is not listed."""
    side = chromosomes.select("chr", F.col("copies").alias("_n"))
    return regions.join(side, "chr", "left").select(key, F.coalesce("_n", F.lit(default)).alias("copies"))


def seeding(groups: DataFrame, copies: DataFrame, cell: list[str], key: str = "region_id") -> DataFrame:
    """(cell, region) with exactly as many candidates as the region has copies."""
    n = groups.groupBy(*cell, key).agg(F.count(F.lit(1)).alias("n"))
    return n.join(copies, key).where("n = copies").select(*cell, key)


def coded(spots: DataFrame, codes: DataFrame) -> DataFrame:
    """Spots whose bit is in the codebook, with the region of codes of one bit (null for the others)."""
    single = codes.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.min("bit").alias("bit")).where("n = 1").groupBy("bit").agg(F.min("region_id").alias("single_region"))
    return spots.join(codes.select("bit").distinct(), "bit", "left_semi").join(single, "bit", "left")


def within_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose values lie in closed ranges, such as background, height and widths; nulls do not."""
    for c, (lo, hi) in ranges.items():
        df = df.where(F.col(c).between(lo, hi))
    return df


#: The usual gates of fitted spots.
RANGES = {"background": (100.0, 1e18), "height": (800.0, 1e18), "sigma_xy": (0.5, 3.0), "sigma_z": (0.5, 3.5)}


def in_boxes(spots: DataFrame, boxes: DataFrame, keys: list[str], box: str, width: float = 64.0) -> DataFrame:
    """Spots in closed boxes (<axis>_min, <axis>_max) of the same keys, with the box's id. Boxes are listed under the bins of x that
    they touch."""
    bins = F.sequence(F.floor(F.col("x_min") / width), F.floor(F.col("x_max") / width))
    b = boxes.where("x_min <= x_max").select(*keys, F.struct(box, *[f"{c}_{e}" for c in AXES for e in ("min", "max")]).alias("b"), F.explode(bins).alias("_bin"))
    near = spots.withColumn("_bin", F.floor(F.col("x") / width)).join(b, [*keys, "_bin"])
    for c in AXES:
        near = near.where(F.col(c).between(F.col(f"b.{c}_min"), F.col(f"b.{c}_max")))
    return near.select(*spots.columns, F.col(f"b.{box}").alias(box))


def in_mask(spots: DataFrame, voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Spots whose nearest voxel carries a label, with it."""
    at = [F.round(c).cast("int").alias(f"_{c}") for c in AXES]
    side = voxels.where("label <> 0").select(*keys, *[F.col(c).cast("int").alias(f"_{c}") for c in AXES], "label")
    return spots.select("*", *at).join(side, [*keys, *[f"_{c}" for c in AXES]]).select(*spots.columns, "label")


def off_edges(points: DataFrame, size: dict[str, int], border: float = 2.0) -> DataFrame:
    """Points farther than ``border`` from every face of the image."""
    for c, n in size.items():
        points = points.where((F.col(c) > border) & (F.col(c) < n - border))
    return points


def dimmed(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """Values at or below the threshold become null."""
    return df.withColumn(value, F.when(F.col(value) > threshold, F.col(value)))


def bleed_gates(pairs: DataFrame, least_r2: float, height: tuple[float, float], size: dict[str, int], border: float) -> DataFrame:
    """Bleed-through pairs that are linear enough, bright enough and away from the edges."""
    return off_edges(pairs.where(F.col("r2") >= least_r2).where(F.col("height").between(*height)), size, border)


def nearest_unused(unused: DataFrame, radius: float, keys: list[str], uid: str = "uid") -> DataFrame:
    """Each spot with its nearest other one within ``radius``, as unordered pairs a < b, once each."""
    near = radius_join(unused, unused, radius, keys, F.col(f"l.{uid}") != F.col(f"r.{uid}"))
    best = near.groupBy(F.col(f"l.{uid}").alias("s")).agg(F.min(F.struct("distance", F.col(f"r.{uid}").alias("o"))).alias("m"))
    return best.select(F.least("s", "m.o").alias("a"), F.greatest("s", "m.o").alias("b"), F.col("m.distance").alias("distance")).distinct()


def random_invalid(spots: DataFrame, invalid: DataFrame, keys: list[str], share: float, uid: str = "uid") -> DataFrame:
    """Negative controls: pairs of a cell's spots whose bits no code has, a fixed ``share`` of them drawn by a hash of their ids. The draw
    comes before the pairs meet: each spot keeps only partners whose hashes fall into its window."""
    a, b = (spots.select(*keys, F.col("bit").alias(f"bit_{x}"), F.struct(*spots.columns).alias(x)) for x in "ab")  # bit_a < bit_b in ``invalid``
    part = max(1, round(1 / share))
    h = lambda x: F.conv(F.substring(F.md5(F.col(f"{x}.{uid}").cast("string")), 1, 8), 16, 10).cast("long") % part
    drawn = a.withColumn("_h", h("a")).join(b.withColumn("_h", h("b")), [*keys, "_h"])
    return drawn.join(F.broadcast(invalid), ["bit_a", "bit_b"]).select(*keys, "bit_a", "bit_b", F.col(f"a.{uid}").alias("a"), F.col(f"b.{uid}").alias("b"), distance("a", "b").alias("distance"))


def channel_centred(spots: DataFrame, keys: list[str], channel: str, reference: str) -> DataFrame:
    """Shift each channel's mean place onto that of the reference channel, or of the first channel where there is no spot of it."""
    mean = spots.groupBy(*keys, channel).agg(*[F.avg(c).alias(f"_m{c}") for c in AXES])
    first = F.min(F.struct((F.col(channel) != reference).alias("o"), channel, *[f"_m{c}" for c in AXES])).alias("_ref")
    ref = mean.groupBy(*keys).agg(first)
    both = mean.join(ref, keys).select(*keys, channel, *[(F.col(f"_ref._m{c}") - F.col(f"_m{c}")).alias(f"_s{c}") for c in AXES])
    return spots.join(both, [*keys, channel]).withColumns({c: F.col(c) + F.col(f"_s{c}") for c in AXES}).select(*spots.columns)


def scaled_by(df: DataFrame, value: str, keys: list[str], method: str = "mean") -> DataFrame:
    """Values over the group's mean, median, max or sum; the group's figure comes from an aggregate, so no group is sorted."""
    how = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "max": F.max, "sum": F.sum}[method]
    return df.join(df.groupBy(*keys).agg(how(value).alias("_by")), keys).withColumn(value, F.col(value) / F.nullif("_by", F.lit(0.0))).select(*df.columns)


def rigid(points: DataFrame, transforms: DataFrame, keys: list[str]) -> DataFrame:
    """Rotate x, y about a centre and subtract a drift, by the transform of the point's keys: degrees, centre_x, centre_y, drift_<axis>."""
    c, s = F.cos(F.radians("degrees")), F.sin(F.radians("degrees"))
    dx, dy = F.col("x") - F.col("centre_x"), F.col("y") - F.col("centre_y")
    moved = {"z": F.col("z") - F.col("drift_z"), "x": c * dx - s * dy + F.col("centre_x") - F.col("drift_x"), "y": s * dx + c * dy + F.col("centre_y") - F.col("drift_y")}
    return points.join(transforms, keys).withColumns(moved).select(*points.columns)


def shifted_boxes(boxes: DataFrame, drift: dict[str, Column], size: dict[str, int]) -> DataFrame:
    """Boxes moved by a drift, rounded, and clamped to the image; a box that has left it is empty (min > max)."""
    out = {}
    for c, n in size.items():
        lo, hi = F.round(F.col(f"{c}_min") + drift[c]).cast("int"), F.round(F.col(f"{c}_max") + drift[c]).cast("int")
        out |= {f"{c}_min": F.greatest(F.lit(0), lo), f"{c}_max": F.least(F.lit(n - 1), hi)}
    return boxes.withColumns(out)


def relative_overlap(overlap: Column, a: str, b: str, axes: tuple[str, ...] = AXES) -> Column:
    """An overlap over the smaller box's volume."""
    volume = lambda x: F.aggregate(F.array(*[F.col(f"{x}.{c}_max") - F.col(f"{x}.{c}_min") for c in axes]), F.lit(1.0), lambda t, v: t * v)
    return overlap / F.nullif(F.least(volume(a), volume(b)), F.lit(0.0))


def kinds(usage: DataFrame) -> DataFrame:
    """Per kind of label: how many images there are, and their numbers in order."""
    return usage.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("number")).alias("numbers"))
