"""Neighbours among the points of one group, exact, found box by box and held in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all of a to all of b, summed in the order of the axes."""
    return np.sqrt((a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2 + (a[:, None, 2] - b[None, :, 2]) ** 2)


def halves(xyz: np.ndarray, size: int = 64) -> list[np.ndarray]:
    """The points' indexes in leaves of at most ``size``, by halving along the widest axis."""
    out, todo = [], [np.arange(len(xyz))] if len(xyz) else []
    while todo:
        g = todo.pop()
        if len(g) <= size:
            out.append(g)
            continue
        axis = int(np.ptp(xyz[g], axis=0).argmax())
        g = g[np.argpartition(xyz[g, axis], len(g) // 2)]
        todo += [g[: len(g) // 2], g[len(g) // 2 :]]
    return out


class Leaves:
    """Points in leaves, with their boxes."""

    def __init__(self, xyz: np.ndarray):
        self.xyz, self.leaves = xyz, halves(xyz)
        self.size = np.array([len(g) for g in self.leaves])
        self.low, self.high = (np.array([f(xyz[g], axis=0) for g in self.leaves]).reshape(-1, 3) for f in (np.min, np.max))

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """At least how far each leaf is from all of the points; a hair less, for the rounding."""
        d = np.maximum(np.maximum(self.low - points.max(0), points.min(0) - self.high), 0)
        return np.sqrt((d * d).sum(1)) * (1 - 1e-12)

    def of(self, leaves: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate([self.leaves[k] for k in leaves])) if len(leaves) else np.zeros(0, int)


def nearest(points: np.ndarray, others: np.ndarray, k: int, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each point's k nearest others (fewer if there are fewer), by rising distance, the lower index on ties: indexes and distances. ``own``: both are the same
    points, and none is its own neighbour."""
    k = max(0, min(k, len(others) - own))
    index, distance = np.zeros((len(points), k), int), np.zeros((len(points), k))
    if not k:
        return index, distance
    tree = Leaves(others)

    def met(g: np.ndarray, among: np.ndarray) -> np.ndarray:
        d = apart(points[g], others[among])
        if own:
            d[g[:, None] == among[None]] = np.inf
        return d

    for g in halves(points):
        gap = tree.gaps(points[g])
        order = np.argsort(gap)
        enough = int(np.searchsorted(np.cumsum(tree.size[order]), k + own)) + 1
        worst = np.partition(met(g, tree.of(order[:enough])), k - 1, axis=1)[:, k - 1].max()
        among = tree.of(np.flatnonzero(gap <= worst))
        d = met(g, among)
        best = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
        least = np.take_along_axis(d, best, 1)
        for r in np.flatnonzero((d <= least.max(1)[:, None]).sum(1) > k):  # as far as the last: the lowest ones
            best[r] = np.sort(np.argsort(d[r], kind="stable")[:k])
        least = np.take_along_axis(d, best, 1)
        by = np.argsort(least, axis=1, kind="stable")
        index[g], distance[g] = among[np.take_along_axis(best, by, 1)], np.take_along_axis(least, by, 1)
    return index, distance


def within(points: np.ndarray, others: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of points, the others that may be within ``radius`` of one of them (rising), and all distances between both."""
    tree = Leaves(others)
    for g in halves(points):
        among = tree.of(np.flatnonzero(tree.gaps(points[g]) <= radius)) if len(others) else np.zeros(0, int)
        yield g, among, apart(points[g], others[among])


def cliques(xyz: np.ndarray, radius: float) -> Iterator[np.ndarray]:
    """The balls (indexes, rising) around each point whose members are all within ``radius`` of each other. A ball is left at the first member found that is too
    far from another, beginning with the one farthest from the centre, and a ball that several points have, such as those of one place, is looked at once."""
    seen: set[bytes] = set()
    for g, among, d in within(xyz, xyz, radius):
        near = d <= radius
        for r in range(len(g)):
            ball = among[near[r]]
            p = xyz[ball]
            far = int(d[r][near[r]].argmax())
            if not (apart(p[far : far + 1], p) <= radius).all():
                continue
            mark = hashlib.blake2b(ball.tobytes(), digest_size=16).digest()
            if mark in seen:
                continue
            seen.add(mark)
            if all((apart(p[k : k + 256], p) <= radius).all() for k in range(0, len(p), 256)):
                yield ball
