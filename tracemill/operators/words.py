"""Words of sequences, cut in Arrow batches. Plain bases are packed two bits each; rows with other letters go by text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that are looked at together; longest word that is packed; longest of which all counts are held.
BLOCK, PACKED, HELD = 1 << 20, 31, 10
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def _packed(letters: np.ndarray, k: int) -> np.ndarray:
    """The codes of all windows of k, by doubling their length."""
    code, held, length, out, done = letters.astype(np.int32 if k < 16 else np.int64), None, 1, None, 0
    while True:
        if k & length:  # the next ``length`` letters of the word
            out = code if out is None else out[: len(code) - done] * code.dtype.type(4**length) + code[done : done + len(out)][: len(code) - done]
            done += length
        if done == k:
            return out[: max(0, len(letters) - k + 1)]
        code = code[:-length] * code.dtype.type(4**length) + code[length:]
        length *= 2


def spelled(codes: np.ndarray, k: int) -> pa.Array:
    """Codes as words."""
    shift = 2 * np.arange(k - 1, -1, -1)
    letters = np.frombuffer(b"ACGT", np.uint8)[((codes.astype(np.int64)[:, None] >> shift) & 3).astype(np.uint8)]
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(0, (len(codes) + 1) * k, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))


def _rows(seqs: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray] | tuple[int, str]]:
    """Blocks of (row, place in the row, code) of all words of plain rows, and (row, text) of the others."""
    seqs = seqs.cast(pa.string())
    ends = np.frombuffer(seqs.buffers()[1], np.int32)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64)
    data = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)
    known = seqs.is_valid().to_numpy(zero_copy_only=False)
    odd = np.zeros(len(seqs), bool)
    for a in range(int(ends[0]), int(ends[-1]), BLOCK):
        at = a + np.flatnonzero(_CODE[data[a : min(a + BLOCK, ends[-1])]] == 4)
        odd[np.unique(np.searchsorted(ends, at, side="right") - 1)] = True
    odd = (odd | (k > PACKED)) & known
    for r in np.flatnonzero(odd):
        yield int(r), seqs[int(r)].as_py()
    for a in range(int(ends[0]), int(ends[-1]), BLOCK):
        b = min(a + BLOCK, int(ends[-1]))
        codes = _packed(_CODE[data[a : min(b + k - 1, int(ends[-1]))]] & 3, k) if k <= PACKED else []
        if not len(codes):
            continue
        first, last = np.searchsorted(ends, a, side="right") - 1, np.searchsorted(ends, a + len(codes) - 1, side="right") - 1
        stretch = np.diff(np.clip(ends[first : last + 2], a, a + len(codes)))
        row = np.repeat(np.arange(first, last + 1), stretch)
        place = np.arange(a, a + len(codes))
        ok = (place + k <= ends[row + 1]) & ~odd[row] & known[row]
        yield row[ok], (place - ends[row])[ok], codes[ok]


def counted(sequences: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """word, n: counts of each task, of which several may name a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, other = np.zeros(4**k if k <= HELD else 0, np.int64), Counter()
        made = lambda words, n: pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])
        for batch in batches:
            for found in _rows(batch.column(0), k):
                if len(found) == 2:
                    other.update(found[1][i : i + k] for i in range(len(found[1]) - k + 1))
                    if len(other) > BLOCK:
                        yield made(pa.array(list(other), pa.string()), list(other.values()))
                        other.clear()
                elif k <= HELD:
                    total += np.bincount(found[2], minlength=len(total))
                else:
                    codes, n = np.unique(found[2], return_counts=True)
                    yield made(spelled(codes, k), n)
        at = np.flatnonzero(total)
        for a in range(0, len(at), BLOCK):
            yield made(spelled(at[a : a + BLOCK], k), total[at[a : a + BLOCK]])
        if other:
            yield made(pa.array(list(other), pa.string()), list(other.values()))

    return sequences.select(seq).mapInArrow(run, "word string, n bigint")


_BITS = 24


def _slot(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.int64)
    return (codes ^ (codes >> _BITS) ^ (codes >> 2 * _BITS)) & ((1 << _BITS) - 1)


def places(texts: DataFrame, words: DataFrame, k: int, length: int, uid: str, seq: str) -> DataFrame:
    """Where words may stand: uid and the text from there on, ``length`` letters at most. Words of plain bases are marked in a map of 2^24 bits, which is what tasks get; so that places are left
    out at which none stands, and some stay. Rows with other letters list all of their places."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _rows(batch.column(0), k):
                if len(found) == 3:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(found[2])), pa.int64())], names=["slot"])

    rows = words.mapInArrow(marked, "slot bigint").groupBy(F.expr("slot div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).collect()
    held = np.zeros((1 << _BITS) // 64, np.int64)
    held[[r["at"] for r in rows]] = [r["bits"] for r in rows]
    bits = np.packbits(np.unpackbits(held.astype("<i8").view(np.uint8), bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(bits).astype(bool)
        for batch in batches:
            ids, seqs = batch.column(0), batch.column(1).cast(pa.string())
            for found in _rows(seqs, k):
                if len(found) == 2:
                    row, place = np.full(max(0, len(found[1]) - k + 1), found[0]), np.arange(max(0, len(found[1]) - k + 1))
                    text = [found[1][i : i + length] for i in place]
                else:
                    some = asked[_slot(found[2])]
                    row, place = found[0][some], found[1][some]
                    whole = {r: seqs[r].as_py() for r in np.unique(row).tolist()} if length > k else {}
                    text = [whole[r][i : i + length] for r, i in zip(row.tolist(), place.tolist(), strict=True)] if whole else spelled(found[2][some], k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), text if isinstance(text, pa.Array) else pa.array(text, pa.string())], names=[uid, "text"])

    return texts.select(uid, seq).mapInArrow(run, f"{uid} {texts.schema[uid].dataType.simpleString()}, text string")
