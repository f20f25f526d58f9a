"""Hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BYTE = np.random.default_rng(20).integers(0, 2**64, 256 * 64, U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def word_hashes(folded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts whose words are separated by spaces, and the words of each text: a random number
    for each byte value and place (modulo 64), added up over the word and mixed."""
    size = np.fromiter((len(t) + 1 for t in folded), np.int64, len(folded))
    joined = np.frombuffer(b" ".join(folded) + b" ", np.uint8)
    inside = joined != 32
    edges = np.flatnonzero(np.r_[inside[0], inside[1:] != inside[:-1]])
    start, length = edges[::2], np.diff(edges)[::2]
    if not len(start):
        return np.zeros(0, U), np.zeros(len(folded), np.int64)
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), length)
    value = _BYTE[joined[inside] + ((at & 63) << 8)]
    if length.max() > 64:
        value *= ((at >> 6) * 2 + 1).astype(U)
    return mix(np.add.reduceat(value, first)), np.diff(np.searchsorted(start, np.cumsum(size)), prepend=0)
