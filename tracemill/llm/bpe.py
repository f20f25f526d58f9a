"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are split by the vocabulary's pattern. A block of texts (bounded bytes) is one corpus: its distinct words are laid out
once as one linked list of symbols, and an inverted index maps each adjacent symbol pair that merges to the positions where it stands.
Merges are then replayed over the whole block in rank order, each touching just the positions listed for its pair and
re-indexing only the two neighbours of what it joined. Documents are assembled from their words' ids. Blocks never need
each other, so nothing is shuffled and a lost task repeats its own rows only.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracemill.llm.arrow import blocks, tidy, with_columns
from tracemill.llm.common import table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encoder for a fixed vocabulary: ``ranks`` maps byte strings to ids, and lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(a << 32 | b, i) for word, i in ranks.items() for cut in range(1, len(word)) if (a := ranks.get(word[:cut])) is not None and (b := ranks.get(word[cut:])) is not None]
        self.pairs, self.becomes = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        # symbols that may take part, as soon as they are made, in a merge of lower rank than their own
        lower = self.pairs[self.becomes < np.maximum(self.pairs >> 32, self.pairs & 0xFFFFFFFF)]
        self.early = set((lower >> 32).tolist()) | set((lower & 0xFFFFFFFF).tolist())

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or -1."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.becomes[at], -1)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. A word that is in the vocabulary is one id; the others go through the replay."""
        out: list = [[self.ranks[w]] if w in self.ranks else None for w in words]
        todo = [i for i, x in enumerate(out) if x is None]
        if not todo:
            return out
        lengths = np.fromiter((len(words[i]) for i in todo), np.int64, len(todo))
        ends = np.cumsum(lengths)
        symbol = self.single[np.frombuffer(b"".join(words[i] for i in todo), np.uint8)]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lengths] = -1, -1
        owner = np.repeat(np.arange(len(todo)), lengths)
        index: dict[int, list[np.ndarray]] = {}  # rank of a merge -> positions of its left symbols
        heap: list[int] = []

        def note(places: np.ndarray) -> np.ndarray:
            """Index the pairs that begin at ``places``; returns their ranks."""
            ranks = self.joins(symbol[places], symbol[after[places]])
            order = np.argsort(ranks, kind="stable")
            order = order[np.searchsorted(ranks[order], 0) :]
            if len(order):
                r, p = ranks[order], places[order]
                cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
                for rank, lo, hi in zip(r[np.r_[0, cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(r)], strict=True):
                    if rank in index:
                        index[rank].append(p[lo:hi])
                    else:
                        index[rank] = [p[lo:hi]]
                        heapq.heappush(heap, rank)
            return ranks

        def merge(p: np.ndarray, rank: int) -> np.ndarray:
            """Join the symbols at ``p`` to those after them; returns the owners of new pairs with a rank below this one."""
            q = after[p]
            symbol[p], symbol[q] = rank, -1
            follow = after[q]
            after[p] = follow
            right = follow >= 0
            before[follow[right]] = p[right]
            left = before[p]
            fresh = np.concatenate([left[left >= 0], p[right]])
            ranks = note(fresh)
            return owner[fresh[(ranks >= 0) & (ranks < rank)]]

        note(np.flatnonzero(after >= 0))
        while heap:
            rank = heapq.heappop(heap)
            p = np.unique(np.concatenate(index.pop(rank)))
            while True:
                p = p[(symbol[p] >= 0) & (after[p] >= 0)]
                p = p[self.joins(symbol[p], symbol[after[p]]) == rank]
                if not len(p):
                    break
                if rank not in self.early:
                    # of places that overlap, every second one, from the left
                    i = np.arange(len(p))
                    start = np.r_[True, after[p[:-1]] != p[1:]]
                    p = p[(i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0]
                    merge(p, rank)
                    break
                # one merge a word at a time; a word in which an earlier merge has arisen waits for that one
                first = np.r_[True, owner[p[1:]] != owner[p[:-1]]]
                waiting = merge(p[first], rank)
                p = p[~first]
                held = np.isin(owner[p], waiting)
                if held.any():
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(heap, rank)
                    index[rank].append(p[held])
                    p = p[~held]
        whole = symbol >= 0
        ids, counts = symbol[whole].tolist(), np.add.reduceat(whole, ends - lengths, dtype=np.int64) if n else []
        at = 0
        for i, count in zip(todo, np.asarray(counts).tolist(), strict=True):
            out[i] = ids[at : at + count]
            at += count
        return out

    def split(self, text: str) -> list[str]:
        return self.words.findall(text)

    def encode_block(self, texts: Iterable[str]) -> tuple[list[array], list[list[int]]]:
        """Numbers of the words of each text, and the ids of each word by its number."""
        numbers: dict[str, int] = {}
        parts = []
        for t in texts:
            parts.append(array("I", [numbers.setdefault(w, len(numbers)) for w in self.split(t)]))
        return parts, self.encode_words([w.encode() for w in numbers])

    def encode(self, text: str) -> list[int]:
        parts, ids = self.encode_block([text])
        return [i for w in parts[0] for i in ids[w]]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def shipped(spark: SparkSession, path: str) -> str:
    """Hand a driver-side file to every executor; returns the name to look it up by."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


_held: dict[tuple[str, str], MergeReplay] = {}


def replay_of(name: str, pattern: str) -> MergeReplay:
    """The encoder for a shipped vocabulary, built once in each worker process."""
    if (name, pattern) not in _held:
        _held[name, pattern] = MergeReplay(read_ranks(SparkFiles.get(name)), pattern)
    return _held[name, pattern]


def encoded(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """Encode ``text`` and decode it again.

    Adds n_tokens, ids_sha256, decoded_sha256 and, if asked, token_ids, in place of ``text``; other columns pass through,
    and those that have one of these names are replaced. Null texts count as empty: no tokens, digests of nothing.
    ``vocabulary``: path of a rank file on the driver.
    """
    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] + [("token_ids", T.ArrayType(T.IntegerType()))] * ids
    docs = docs.drop(*[k for k, _ in added])
    schema = T.StructType([f for f in docs.schema.fields if f.name != text] + [T.StructField(k, t) for k, t in added])
    name = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = replay_of(name, pattern)
        for rest, texts in blocks(batches, text, 8 << 20):
            parts, word_ids = replay.encode_block(t.decode() for t in texts)
            # a word's digits and its decoded bytes are made once; both join up to those of the text
            digits = [",".join(map(str, x)) for x in word_ids]
            spelled = [replay.decode(x) for x in word_ids]
            length = list(map(len, word_ids))
            out = {
                "n_tokens": pa.array([sum(map(length.__getitem__, p)) for p in parts], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(",".join(map(digits.__getitem__, p)).encode()).hexdigest() for p in parts]),
                "decoded_sha256": pa.array([hashlib.sha256(b"".join(map(spelled.__getitem__, p))).hexdigest() for p in parts]),
            }
            if ids:
                out["token_ids"] = pa.array([[i for w in p for i in word_ids[w]] for p in parts], pa.list_(pa.int32()))
            yield with_columns(rest, out)

    return docs.mapInArrow(tidy(run), schema)


def op2_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
