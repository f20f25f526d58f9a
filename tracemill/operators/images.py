"""Operators on image planes and stacks. A row is one image (or frame): its keys, shape and pixels; kernels see one image at a time.

Stacks are float arrays [z, x, y] inside kernels and little-endian 16-bit pixels in tables.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = ("depth", "height", "width")


def array_of(row) -> np.ndarray:
    return np.frombuffer(row.pixels, "<u2").reshape(row.depth, row.height, row.width).astype(float)


def pixels_of(stack: np.ndarray) -> bytes:
    return np.clip(np.rint(stack), 0, 65535).astype("<u2").tobytes()


def mapped(images: DataFrame, run: Callable[[np.ndarray, tuple], np.ndarray]) -> DataFrame:
    """Images with the pixels that ``run`` makes of each, the row as its second argument; same shape."""

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for k, row in enumerate(df.itertuples(index=False)):
                one = df.iloc[[k]].copy()
                one["pixels"] = [pixels_of(run(array_of(row), row))]
                yield one

    return images.mapInPandas(batch, images.schema)


def stacked(frames: DataFrame, keys: list[str], channels: int, buffer: int = 0) -> DataFrame:
    """Frames of movies (keys, frame, height, width, pixels) as one stack per channel: every ``channels``-th frame, without ``buffer`` frames at both ends."""
    n = frames.groupBy(*keys).agg(F.max("frame").alias("_last"))
    use = frames.join(n, keys).where((F.col("frame") >= buffer) & (F.col("frame") <= F.col("_last") - buffer))
    use = use.withColumn("channel", ((F.col("frame") - buffer) % channels).cast("int"))
    out = use.groupBy(*keys, "channel").agg(F.first("height").alias("height"), F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("frame", "pixels"))).alias("f"))
    whole = F.aggregate(F.transform("f", lambda x: x["pixels"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return out.select(*keys, "channel", F.size("f").alias("depth"), "height", "width", whole.alias("pixels"))


# ---- kernels ----


def blurred(a: np.ndarray, sigma: float, axes: tuple[int, ...] = (-2, -1), truncate: float = 4.0) -> np.ndarray:
    """Gaussian blur along some axes; edges are mirrored."""
    r = int(truncate * sigma + 0.5)
    if r < 1:
        return a.astype(float)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = a.astype(float)
    for axis in axes:
        pad = [(0, 0)] * out.ndim
        pad[axis] = (r, r)
        wide = np.pad(out, pad, mode="symmetric" if r <= out.shape[axis] else "edge")
        n = out.shape[axis]
        out = sum(w * np.take(wide, range(i, i + n), axis=axis) for i, w in enumerate(k))
    return out


def without_hot_pixels(a: np.ndarray, threshold: float = 0.5, ratio: float = 3.0) -> np.ndarray:
    """Pixels that exceed the mean of their four neighbours in at least ``threshold`` of the planes by ``ratio`` times that become that mean."""
    wide = np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="reflect") if min(a.shape[1:]) > 1 else np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="edge")
    mean = (wide[:, :-2, 1:-1] + wide[:, 2:, 1:-1] + wide[:, 1:-1, :-2] + wide[:, 1:-1, 2:]) / 4
    hot = (a > ratio * mean).mean(0) >= threshold
    return np.where(hot[None], mean, a)


def high_passed(a: np.ndarray, sigma: float = 5.0) -> np.ndarray:
    """The image less its blur, not below 0."""
    return np.maximum(a - blurred(a, sigma), 0)


def deconvolved(a: np.ndarray, sigma: float, rounds: int = 10) -> np.ndarray:
    """Richardson-Lucy steps with a Gaussian."""
    est = np.maximum(a.astype(float), 1e-6)
    for _ in range(rounds):
        est = est * blurred(a / np.maximum(blurred(est, sigma), 1e-6), sigma)
    return est


def warped(a: np.ndarray, shift: tuple[float, float, float] | np.ndarray, fill: float = 0.0) -> np.ndarray:
    """The image at places moved by ``shift`` (z, x, y; or an array [3, z, x, y] of shifts), linear between pixels, ``fill`` outside."""
    grid = np.stack(np.meshgrid(*[np.arange(n, dtype=float) for n in a.shape], indexing="ij"))
    at = grid + (np.asarray(shift, float).reshape(3, 1, 1, 1) if np.ndim(shift) == 1 else shift)
    lo = np.floor(at).astype(int)
    part, out = at - lo, np.zeros(a.shape)
    inside = np.ones(a.shape, bool)
    for k, n in enumerate(a.shape):
        inside &= (at[k] >= 0) & (at[k] <= n - 1)
    for corner in np.ndindex(2, 2, 2):
        index, weight = [], np.ones(a.shape)
        for k, c in enumerate(corner):
            index.append(np.clip(lo[k] + c, 0, a.shape[k] - 1))
            weight = weight * (part[k] if c else 1 - part[k])
        out += weight * a[tuple(index)]
    return np.where(inside, out, fill)


def phase_shift(reference: np.ndarray, a: np.ndarray, crops: int = 1) -> np.ndarray:
    """By how much ``a`` is moved against ``reference`` (whole pixels), by phase correlation; with ``crops`` the median over as many strips."""
    found = []
    for r, x in zip(np.array_split(reference, crops, axis=-1), np.array_split(a, crops, axis=-1), strict=True):
        cross = np.fft.fftn(x - x.mean()) * np.conj(np.fft.fftn(r - r.mean()))
        peak = np.fft.ifftn(cross / np.maximum(np.abs(cross), 1e-9)).real
        at = np.array(np.unravel_index(int(peak.argmax()), peak.shape), float)
        size = np.array(peak.shape)
        found.append(np.where(at > size // 2, at - size, at))
    return np.median(found, axis=0)


def bead_shift(reference: np.ndarray, points: np.ndarray, cell: float = 1.0, most: float = 50.0) -> np.ndarray:
    """The median difference of points and reference points whose differences agree best."""
    d = (points[:, None] - reference[None]).reshape(-1, 3)
    d = d[(np.abs(d) <= most).all(1)]
    if not len(d):
        return np.zeros(3)
    votes: dict[tuple, list] = {}
    for x, g in zip(d, np.floor(d / cell).astype(int).tolist(), strict=True):
        votes.setdefault(tuple(g), []).append(x)
    best = max(sorted(votes), key=lambda g: len(votes[g]))
    near = d[(np.abs(d - np.median(votes[best], axis=0)) <= 2 * cell).all(1)]
    return np.median(near, axis=0)


def seeds(a: np.ndarray, least: float, sigma: float = 0.75, background: float = 7.5, most: int | None = None, border: int = 1) -> np.ndarray:
    """Local maxima of the blurred image less its background that reach ``least``, brightest first: rows z, x, y, height."""
    d = blurred(a, sigma, (-3, -2, -1)) - blurred(a, background, (-2, -1))
    wide = np.pad(d, 1, constant_values=-np.inf)
    top = np.ones(a.shape, bool)
    for o in np.ndindex(3, 3, 3):
        if o != (1, 1, 1):
            there = wide[tuple(slice(k, k + n) for k, n in zip(o, a.shape, strict=True))]
            top &= (d > there) if o < (1, 1, 1) else (d >= there)
    z, x, y = np.nonzero(top & (d >= least))
    ok = (x >= border) & (x < a.shape[1] - border) & (y >= border) & (y < a.shape[2] - border)
    rows = np.stack([z, x, y, d[z, x, y]], 1)[ok]
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0], -rows[:, 3]))][:most]


def fitted(a: np.ndarray, seed: np.ndarray, radius: int = 3, rounds: int = 30) -> tuple[float, ...] | None:
    """A Gaussian on a constant background around a seed, by damped Gauss-Newton steps: height, z, x, y, background, sigma_z, sigma_xy; None where it does not stay near."""
    lo = np.maximum(np.rint(seed).astype(int) - radius, 0)
    hi = np.minimum(np.rint(seed).astype(int) + radius + 1, a.shape)
    grid = np.stack(np.meshgrid(*[np.arange(p, q, dtype=float) for p, q in zip(lo, hi, strict=True)], indexing="ij")).reshape(3, -1)
    v = a[lo[0] : hi[0], lo[1] : hi[1], lo[2] : hi[2]].ravel()
    p = np.array([v.max() - np.median(v), *seed, np.median(v), np.log(1.2), np.log(1.2)], float)
    damp = 1e-2

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.exp(np.array([p[5], p[6], p[6]]))[:, None]
        u = (grid - p[1:4, None]) / s
        g = np.exp(-0.5 * (u**2).sum(0))
        j = np.stack([g, *(p[0] * g * u / s), np.ones_like(g), p[0] * g * u[0] ** 2, p[0] * g * (u[1] ** 2 + u[2] ** 2)], 1)
        return p[0] * g + p[4], j

    f, j = model(p)
    for _ in range(rounds):
        h, g = j.T @ j, j.T @ (v - f)
        step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), g, rcond=None)[0]
        q = p + step
        q[5:] = np.clip(q[5:], np.log(0.3), np.log(3.0 * radius))
        f2, j2 = model(q)
        if ((v - f2) ** 2).sum() <= ((v - f) ** 2).sum():
            done = np.abs(q - p).max() < 1e-6
            p, f, j, damp = q, f2, j2, damp / 3
            if done:
                break
        else:
            damp *= 5
    if p[0] <= 0 or np.abs(p[1:4] - seed).max() > radius:
        return None
    return (*p[:5].tolist(), float(np.exp(p[5])), float(np.exp(p[6])))


def labelled(mask: np.ndarray) -> np.ndarray:
    """Numbers of the connected parts of a mask (face neighbours), in the order of their first pixels."""
    out = np.zeros(mask.shape, np.int32)
    n = 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        out[start] = n
        todo = deque([start])
        while todo:
            at = todo.popleft()
            for k in range(mask.ndim):
                for s in (-1, 1):
                    there = (*at[:k], at[k] + s, *at[k + 1 :])
                    if 0 <= there[k] < mask.shape[k] and mask[there] and not out[there]:
                        out[there] = n
                        todo.append(there)
    return out


def background_of(a: np.ndarray, bins: int = 256) -> float:
    """The middle of the fullest of equal bins between the 1st and the 99th percentile."""
    lo, hi = np.percentile(a, [1, 99])
    if hi <= lo:
        return float(lo)
    n, edges = np.histogram(a, bins=bins, range=(lo, hi))
    k = int(n.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


def segmented(a: np.ndarray, sigma: float = 2.0, least_pixels: int = 50, ratio: float = 2.0) -> np.ndarray:
    """Labels of the parts of a stack that exceed ``ratio`` times the background after a blur and are large enough, renumbered without gaps."""
    smooth = blurred(a, sigma)
    labels = labelled(smooth > ratio * max(background_of(a), 1e-9))
    size = np.bincount(labels.ravel())
    keep = np.flatnonzero((size >= least_pixels) & (np.arange(len(size)) > 0))
    new = np.zeros(len(size), np.int32)
    new[keep] = np.arange(1, len(keep) + 1)
    return new[labels]


def between_planes(labels: np.ndarray, planes: np.ndarray, depth: int) -> np.ndarray:
    """Label planes at some depths, filled in by the nearest of them (the lower on ties)."""
    near = np.abs(np.arange(depth)[:, None] - np.asarray(planes)[None]).argmin(1)
    return labels[near]


def merged_masks(a: np.ndarray, b: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Labels of ``a``, and those of ``b`` that do not overlap a label of ``a`` by ``least`` of their pixels, numbered on."""
    out, n = a.copy(), int(a.max(initial=0))
    for k in range(1, int(b.max(initial=0)) + 1):
        own = b == k
        if own.any() and (a[own] > 0).mean() < least:
            n += 1
            out[own & (a == 0)] = n
    return out


# ---- tables ----


def hot_pixels_removed(images: DataFrame, threshold: float = 0.5, ratio: float = 3.0) -> DataFrame:
    return mapped(images, lambda a, _: without_hot_pixels(a, threshold, ratio))


def high_pass(images: DataFrame, sigma: float = 5.0) -> DataFrame:
    return mapped(images, lambda a, _: high_passed(a, sigma))


def illuminated(images: DataFrame, profiles: dict[str, np.ndarray], channel: str = "channel") -> DataFrame:
    """Images over their channel's illumination profile [x, y]; the profiles, a few planes, go to the tasks by closure."""
    return mapped(images, lambda a, row: a / np.maximum(profiles[getattr(row, channel)], 1e-6)[None])


def illumination_profile(images: DataFrame, channel: str = "channel", low: float = 5.0, high: float = 95.0, sigma: float = 5.0) -> DataFrame:
    """Per channel the mean, over images, of their blurred sums over z (clipped to percentiles), blurred again, over its maximum: channel, height, width, profile.

    Each image is one plane of a partial sum; sums are added up pixel by pixel in the shuffle, never as a list of planes in a task.
    """

    def planes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for df in frames:
            for row in df.itertuples(index=False):
                a = array_of(row)
                p = blurred(np.clip(a, *np.percentile(a, [low, high])).sum(0)[None], sigma)[0]
                key = (getattr(row, channel), row.height, row.width)
                if key in sums:
                    sums[key][0] += p
                    sums[key][1] += 1
                else:
                    sums[key] = [p, 1]
        rows = [(*k, x, p[x].tolist(), n) for k, (p, n) in sums.items() for x in range(k[1])]
        yield pd.DataFrame(rows, columns=[channel, "height", "width", "x", "line", "n"])

    kind = images.schema[channel].dataType.simpleString()
    parts = images.select(channel, *SHAPE, "pixels").mapInPandas(planes, f"{channel} {kind}, height int, width int, x int, line array<double>, n long")
    cells = parts.select(channel, "height", "width", "x", F.posexplode("line").alias("y", "v"), "n")
    mean = cells.groupBy(channel, "height", "width", "x", "y").agg((F.sum("v") / F.sum("n")).alias("v"))
    lines = mean.groupBy(channel, "height", "width", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "v"))), lambda s: s["v"]).alias("line"))
    whole = lines.groupBy(channel, "height", "width").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("x", "line"))), lambda s: s["line"])).alias("profile"))

    def smooth(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            df = df.copy()
            planes_ = [blurred(np.array(p).reshape(1, h, w), sigma)[0] for p, h, w in zip(df["profile"], df["height"], df["width"], strict=True)]
            df["profile"] = [(p / p.max()).ravel().tolist() for p in planes_]
            yield df

    return whole.mapInPandas(smooth, whole.schema)


def unmixed(images: DataFrame, keys: list[str], matrix: dict[str, dict[str, float]], channel: str = "channel") -> DataFrame:
    """Bleed-through corrected images: each channel less the given shares of the other channels of the same keys. A group is the channels of one stack."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        stacks = {getattr(r, channel): array_of(r) for r in df.itertuples(index=False)}
        out = df.copy()
        out["pixels"] = [pixels_of(stacks[c] - sum((w * stacks[o] for o, w in matrix.get(c, {}).items() if o in stacks), 0.0)) for c in df[channel]]
        return out

    return images.groupBy(*keys).applyInPandas(run, images.schema)


def moved(images: DataFrame, shifts: DataFrame, keys: list[str]) -> DataFrame:
    """Images warped by the shift of their keys (shift_z, shift_x, shift_y: what moves the image's places onto the reference's)."""
    both = images.join(shifts, keys)
    return mapped(both, lambda a, r: warped(a, (r.shift_z, r.shift_x, r.shift_y))).select(*images.columns)


def chromatic(images: DataFrame, constants: dict[str, np.ndarray], channel: str = "channel") -> DataFrame:
    """Images warped by their channel's polynomial shifts: constants [3, terms] on the monomials 1, z, x, y of the centred places."""

    def run(a: np.ndarray, row) -> np.ndarray:
        if getattr(row, channel) not in constants:
            return a
        grid = np.stack(np.meshgrid(*[np.arange(n) - (n - 1) / 2 for n in a.shape], indexing="ij"))
        terms = np.stack([np.ones(a.shape), *grid])
        return warped(a, np.tensordot(constants[getattr(row, channel)], terms, axes=1))

    return mapped(images, run)


def drifts(images: DataFrame, keys: list[str], order: str, crops: int = 1) -> DataFrame:
    """The shift of every image of a group against the first: keys, order, shift_<axis>. Pairs of images meet by a join, one pair a row."""
    first = images.groupBy(*keys).agg(F.min(order).alias("_first"))
    ref = images.join(first, keys).where(F.col(order) == F.col("_first")).select(*keys, F.col("pixels").alias("reference"))
    both = images.select(*keys, order, *SHAPE, "pixels").join(ref, keys)
    kind = lambda c: images.schema[c].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for r in df.itertuples(index=False):
                a = array_of(r)
                ref = np.frombuffer(r.reference, "<u2").reshape(a.shape).astype(float)
                rows.append((*[getattr(r, k) for k in (*keys, order)], *phase_shift(ref, a, crops).tolist()))
            yield pd.DataFrame(rows, columns=[*keys, order, "shift_z", "shift_x", "shift_y"])

    return both.mapInPandas(run, ", ".join([*[f"{k} {kind(k)}" for k in (*keys, order)], "shift_z double, shift_x double, shift_y double"]))


def spots(images: DataFrame, keys: list[str], least: float, most: int = 4000, radius: int = 3) -> DataFrame:
    """Fitted spots of each image: keys, seed (by falling brightness), height, z, x, y, background, sigma_z, sigma_xy."""
    kind = lambda c: images.schema[c].dataType.simpleString()
    names = ["height", "z", "x", "y", "background", "sigma_z", "sigma_xy"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for r in df.itertuples(index=False):
                a = array_of(r)
                rows = [(*[getattr(r, k) for k in keys], n, *f) for n, s in enumerate(seeds(a, least, most=most)) if (f := fitted(a, s[:3], radius)) is not None]
                yield pd.DataFrame(rows, columns=[*keys, "seed", *names])

    return images.mapInPandas(run, ", ".join([*[f"{k} {kind(k)}" for k in keys], "seed int", *[f"{c} double" for c in names]]))


def masks(images: DataFrame, keys: list[str], sigma: float = 2.0, least_pixels: int = 50, ratio: float = 2.0) -> DataFrame:
    """Segmented images as voxels: keys, z, x, y, label."""
    kind = lambda c: images.schema[c].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for r in df.itertuples(index=False):
                labels = segmented(array_of(r), sigma, least_pixels, ratio)
                z, x, y = np.nonzero(labels)
                out = pd.DataFrame({"z": z, "x": x, "y": y, "label": labels[z, x, y]})
                for k in reversed(keys):
                    out.insert(0, k, getattr(r, k))
                yield out

    return images.mapInPandas(run, ", ".join([*[f"{k} {kind(k)}" for k in keys], "z int, x int, y int, label int"]))


def boxes(voxels: DataFrame, keys: list[str], extend: int = 0) -> DataFrame:
    """The box of each label, both ends inside, wider by ``extend``."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("z", "x", "y") for n, f in (("min", lambda c: F.min(c) - extend), ("max", lambda c: F.max(c) + extend))]
    return voxels.where("label > 0").groupBy(*keys, "label").agg(*ends)


def backgrounds(images: DataFrame, keys: list[str]) -> DataFrame:
    """The background of each image."""
    kind = lambda c: images.schema[c].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(*[getattr(r, k) for k in keys], background_of(array_of(r))) for r in df.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[*keys, "background"])

    return images.mapInPandas(run, ", ".join([*[f"{k} {kind(k)}" for k in keys], "background double"]))


def corrected(images: DataFrame, keys: list[str], profiles: dict[str, np.ndarray], matrix: dict[str, dict[str, float]], constants: dict[str, np.ndarray], shifts: DataFrame, channel: str = "channel") -> DataFrame:
    """The whole chain: hot pixels, illumination, bleed-through, chromatic aberration, drift."""
    out = illuminated(hot_pixels_removed(images), profiles, channel)
    return moved(chromatic(unmixed(out, keys, matrix, channel), constants, channel), shifts, keys)


def gated_masks(voxels: DataFrame, images: DataFrame | None, keys: list[str], least_size: int, least_ratio: float) -> DataFrame:
    """Voxels of the labels that are large enough and whose mean signal (images: keys, z, x, y, value) is ``least_ratio`` times that of the voxels without label.
    Without images the voxels have a value of their own, so that rows of one place do not meet each other's."""
    both = voxels if images is None else images.join(voxels.select(*keys, "z", "x", "y", "label"), [*keys, "z", "x", "y"], "left")
    own = both.where("label > 0").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_v"))
    rest = both.where("label is null or label <= 0").groupBy(*keys).agg(F.avg("value").alias("_b"))
    good = own.join(rest, keys, "left").where((F.col("_n") >= least_size) & (F.col("_v") >= least_ratio * F.coalesce("_b", F.lit(0.0)))).select(*keys, "label")
    return voxels.join(good, [*keys, "label"])
