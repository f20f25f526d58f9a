"""Language-model scores by context-tree weighting.

A byte is eight binary decisions. For each node of that binary tree, the last d bytes (d = 0 to ``DEPTH``; A-Z lower-cased) are a context that has
counted zeros and ones, and a Krichevsky-Trofimov estimate. Weighting goes from the deepest contexts up: the probability of all training
bits at a context is half its own estimate's and half the product over the contexts one byte longer. From that follows the weight
of each depth along a path, and so the mix that predicts a bit. Contexts and nodes that training has never seen have no estimate; the mix
ends at the deepest that has. A text is scored to its end, which is a byte of its own (0), like the start that precedes it.

Spark counts (context, byte) strings of depth + 1 bytes over the whole corpus and keeps them as a distributed table. Contexts
that share their last three bytes are handled together, and tasks take as many of these as their strings allow; what they add up to for contexts of two bytes is a
table of its own, of which each task gets the rows of its contexts by a join. Only contexts of up to one byte, at most 257 with 255 nodes
each, go through the driver. Blocks of documents then fetch the predictions of their own distinct strings by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.arrow import blocks, tidy
from tracemill.llm.common import checkpoint, crc_mod, release, table
from tracemill.llm.hashing import U, word_hashes

DEPTH, TOP = 5, 3
CHUNK_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20
#: Strings of a task of subtrees, on average.
TASK_STRINGS = 1 << 20
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: White space that separates tokens becomes a space, A-Z become lower case.
TOKENS = bytes(32 if x == 32 or 9 <= x <= 13 else LOWER[x] for x in range(256))


def strings(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end of every text: the context, most recent byte first, then the byte, packed; and bytes + end
    of each text."""
    pad = b"\0" * depth
    joined = np.frombuffer(b"".join(pad + t.translate(LOWER) + b"\0" for t in texts), np.uint8)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    if not len(texts):
        return np.zeros(0, U), size
    # eight bytes read as one little-endian number from each place on: the first ``depth`` of them are the context
    n = len(joined) - depth
    loads = np.ndarray(n, "<u8", np.pad(joined, (0, 8)), strides=(1,))
    packed = ((loads & U((1 << 8 * depth) - 1)) << U(8)) | joined[depth:]
    keep = np.ones(n, bool)
    ends = np.cumsum(size + depth)[:-1] - depth
    for k in range(depth):
        keep[ends + k] = False
    return packed[keep], size


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, as keys that no string has, and the number of words of each text."""
    hashes, n = word_hashes([t.translate(TOKENS) for t in texts])
    return hashes | U(1 << 63), n


END = U((1 << 63) | 1)  # the token that ends a text


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sorted distinct keys, added up."""
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0, by Stirling's series from 8 on."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        small = x < 8
        shift[small] -= np.log(x[small])
        x[small] += 1
    r = 1 / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r / 1680)))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones in a given order."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - math.log(math.pi)


def mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """ln weighted of nodes, from their counts and ``below``, the ln weighted of all longer contexts together; and the share of their own estimate in it. At the
    greatest depth the estimate stands alone."""
    own = estimate(zeros, ones)
    if below is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, below) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


class Level:
    """The nodes of one depth and bit: sorted keys (context, bits so far), counts, ln weighted, and the weight of their own estimate."""

    def __init__(self, keys, zeros, ones, below=None, weight=None):
        self.keys, self.zeros, self.ones, self.weight = keys, zeros, ones, weight
        if weight is None:
            self.weighted, self.weight = mixed(zeros, ones, below)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def nodes(keys: np.ndarray, n: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From sorted (context, byte) keys and counts: nodes of the given bit with their zeros and ones."""
    of = keys >> U(8 - bit)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    one = ((keys >> U(7 - bit)) & U(1)).astype(bool)
    total = np.add.reduceat(n, first) if len(first) else n
    ones = np.add.reduceat(np.where(one, n, 0), first) if len(first) else n
    return of[first], (total - ones).astype(float), ones.astype(float)


def shorter(keys: np.ndarray, low: int) -> np.ndarray:
    """Drop the oldest byte of the contexts; ``low`` bits follow the context."""
    return ((keys >> U(low + 8)) << U(low)) | (keys & U((1 << low) - 1))


def grow(keys: np.ndarray, n: np.ndarray, depth: int = DEPTH, top: int = TOP) -> dict[tuple[int, int], Level]:
    """All levels from ``depth`` up to ``top``, of whole subtrees: sorted distinct strings and their training counts."""
    out: dict[tuple[int, int], Level] = {}
    for d in range(depth, top - 1, -1):
        for bit in range(8):
            at, zeros, ones = nodes(keys, n, bit)
            below = None
            if d < depth:
                under = out[d + 1, bit]
                below = np.bincount(np.searchsorted(at, shorter(under.keys, bit)), under.weighted, len(at))
            out[d, bit] = Level(at, zeros, ones, below)
        keys, n = _added([(shorter(keys, 8), n)])
    return out


def predict(keys: np.ndarray, levels: dict[tuple[int, int], Level], depth: int = DEPTH) -> np.ndarray:
    """log10 of the probability of each string's last byte after its context."""
    out = np.zeros(len(keys))
    byte = keys & U(255)
    for bit in range(8):
        one = ((byte >> U(7 - bit)) & U(1)).astype(bool)
        left, p = np.ones(len(keys)), np.zeros(len(keys))
        at, seen = levels[0, bit].find((keys >> U(8 * depth + 8) << U(bit)) | (byte >> U(8 - bit)))
        live = np.flatnonzero(seen)
        p[~seen] = 0.5  # nothing is known, not even without context
        at = at[live]
        for d in range(depth + 1):
            level = levels[d, bit]
            if d < depth:
                here = keys[live]
                next_at, seen = levels[d + 1, bit].find((here >> U(8 * (depth - d - 1) + 8) << U(bit)) | (byte[live] >> U(8 - bit)))
            else:
                next_at, seen = at, np.zeros(len(live), bool)
            weight = np.where(seen, level.weight[at], 1.0)
            right = np.where(one[live], level.ones[at], level.zeros[at])
            p[live] += left[live] * weight * (right + 0.5) / (level.zeros[at] + level.ones[at] + 1)
            left[live] *= 1 - weight
            live, at = live[seen], next_at[seen]
        out += np.log10(p)
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b.column(0).to_numpy().view(U), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64)
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    return keys[order], n[order]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node of two-byte contexts: counts, and the ln weighted probabilities of the longer contexts below."""
    keys, n = _gathered(batches)
    keys, n = keys[n > 0], n[n > 0]
    levels = grow(keys, n)
    for bit in range(8):
        level = levels[TOP, bit]
        of, at = np.unique(shorter(level.keys, bit), return_inverse=True)
        context, prefix = (of >> U(bit)).astype(np.int32), (of & U((1 << bit) - 1)).astype(np.int32)
        sums = [np.bincount(at, x, len(of)) for x in (level.zeros, level.ones, level.weighted)]
        yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(prefix | 1 << bit), *map(pa.array, sums)], ["context", "node", "zeros", "ones", "below"])


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of two-byte contexts with their ln weighted and the weight of their own estimate."""
    for b in batches:
        zeros, ones, below = (b.column(k).to_numpy() for k in (2, 3, 4))
        both, weight = mixed(zeros, ones, below)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(both), pa.array(weight)], ["context", "node", "zeros", "ones", "weighted", "weight"])


def _level_two(rows: pa.Table) -> dict[tuple[int, int], Level]:
    """Depth 2 from its rows."""
    out = {}
    context, node, zeros, ones, weight = (rows.column(c).to_numpy() for c in ("context", "node", "zeros", "ones", "weight"))
    for bit in range(8):
        mine = np.flatnonzero((node >= 1 << bit) & (node < 2 << bit))
        keys = (context[mine].astype(np.uint64) << U(bit)) | (node[mine] - (1 << bit)).astype(np.uint64)
        order = np.argsort(keys)
        at = mine[order]
        out[2, bit] = Level(keys[order], zeros[at], ones[at], weight=weight[at])
    return out


def _top_levels(rows) -> dict[tuple[int, int], Level]:
    """Depths 1 and 0 from the sums of depth 2."""
    out = {}
    of = np.array([(r.context, r.node, r.zeros, r.ones, r.below) for r in rows], float).reshape(-1, 5)
    for bit in range(8):
        mine = of[(of[:, 1] >= 1 << bit) & (of[:, 1] < 2 << bit)]
        prefix = mine[:, 1].astype(np.uint64) - U(1 << bit)
        key = (mine[:, 0].astype(np.uint64) << U(bit)) | prefix
        order = np.argsort(key)
        one = out[1, bit] = Level(key[order], mine[order, 2], mine[order, 3], mine[order, 4])
        root, at = np.unique(shorter(one.keys, bit), return_inverse=True)
        out[0, bit] = Level(root, *[np.bincount(at, x, len(root)) for x in (one.zeros, one.ones, one.weighted)])
    return out


def _batches(keys: np.ndarray, columns: dict[str, np.ndarray], rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    names = ["key", *columns]
    for lo in range(0, len(keys), rows):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + rows]) for x in (keys.view(np.int64), *columns.values())], names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings and tokens of the texts with their numbers in training texts (0: only in held-out ones)."""
    for rest, texts in blocks(batches, "text", 2 * CHUNK_BYTES):
        out = rest.column(0).to_numpy(zero_copy_only=False)
        parts = []
        for held in (False, True):
            own = [t for t, h in zip(texts, out, strict=True) if h == held]
            if own:
                keys, n = counted(np.concatenate([strings(own)[0], tokens(own)[0], np.full(len(own), END)]))
                parts.append((keys, n * (not held)))
        keys, n = _added(parts)
        yield from _batches(keys, {"n": n})


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct strings and tokens of each block."""
    held: dict[int, np.ndarray] = {}
    for rest, texts in blocks(batches, "text", CHUNK_BYTES):
        of = rest.column(rest.schema.get_field_index("block")).to_numpy()
        for block in np.unique(of).tolist():
            own = [texts[i] for i in np.flatnonzero(of == block)]
            keys = counted(np.concatenate([strings(own)[0], tokens(own)[0], np.full(1, END)]))[0]
            held[block] = counted(np.concatenate([held[block], keys]))[0] if block in held else keys
    for block, keys in held.items():
        yield from _batches(keys, {"block": np.full(len(keys), block, np.int64)})


def _scored(constants: tuple[int, int]):
    n_all, n_distinct = constants

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        keys, value = known.column("key").to_numpy().view(U), known.column("value").to_numpy()
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        out = docs.select(["doc_id", "held_out"])
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for _, texts in blocks(docs.to_batches(), "text", CHUNK_BYTES):
            for lo in range(0, len(texts), 1 << 15):
                for c, x in zip(columns, _chunk(texts[lo : lo + (1 << 15)], keys, value, n_all, n_distinct), strict=True):
                    c.append(x)
        n, n_known, base, score, length = (np.concatenate(c) if c else np.zeros(0) for c in columns)
        more = {"n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array(np.full(len(n), n_all), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()), "code_length": pa.array(length, pa.float64())}
        for k, x in more.items():
            out = out.append_column(k, x)
        return out

    return run


def _chunk(texts: list[bytes], keys: np.ndarray, value: np.ndarray, n_all: int, n_distinct: int):
    """Per text (32,768 at most): tokens, known ones, base score and score, by the values of the block's keys."""
    m = len(texts)
    # a string's 48 bits and the text's 15 are sorted as one number; each run of equal strings is looked up once
    packed, size = strings(texts)
    packed = (packed << U(15)) | np.repeat(np.arange(m, dtype=np.uint64), size)
    packed.sort()
    of = packed >> U(15)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    found = value[np.searchsorted(keys, of[first])]
    score = np.bincount((packed & U((1 << 15) - 1)).astype(np.int64), np.repeat(found, np.diff(np.r_[first, len(of)])), m)
    words, n = tokens(texts)
    c = value[np.searchsorted(keys, words)]
    doc = np.repeat(np.arange(m), n)
    whole = n_all + n_distinct + 1
    end = value[np.searchsorted(keys, END)]
    base = np.bincount(doc, np.log10((c + 1) / whole), m) + math.log10((end + 1) / whole)
    return n + 1, np.bincount(doc[c > 0], minlength=m) + int(end > 0), base, score, -score * math.log2(10) / size


def scored(docs: DataFrame, held_out) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), learning from the rows where ``held_out`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, both log10 probabilities, and code_length, the bits that the model
    takes for a byte (the end is one); a null text is empty and has one token, its end. Repeated rows are learned from and scored as often as they stand there; other
    columns are not looked at. Without any training text, each bit has probability 1/2.
    """
    docs = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    every = docs.select("held_out", "text").mapInArrow(tidy(_count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    every = checkpoint(every)
    is_string = F.col("key") >= 0
    words = every.where(~is_string)
    n_all, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    spark = docs.sparkSession
    # as many tasks as their strings need, whatever the session's number; a three-byte context is the smallest unit
    strings_ = every.where(is_string)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-strings_.count() // TASK_STRINGS))
    sums = strings_.repartition(tasks, F.shiftright("key", 8 * (DEPTH - TOP + 1))).mapInArrow(tidy(_sums), "context int, node int, zeros double, ones double, below double")
    sums = sums.groupBy("context", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    two = checkpoint(sums.mapInArrow(_weighed, "context int, node int, zeros double, ones double, weighted double, weight double"))
    one = two.groupBy(F.shiftright("context", 8).alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
    top = spark.sparkContext.broadcast(_top_levels(one.collect()))

    def predictions(own: pa.Table, nodes_: pa.Table) -> pa.Table:
        keys, n = own.column("key").to_numpy().view(U), own.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        levels = grow(keys[n > 0], n[n > 0]) | _level_two(nodes_) | top.value
        value = [predict(keys[lo : lo + (1 << 17)], levels) for lo in range(0, len(keys), 1 << 17)]
        return pa.table({"key": pa.array(keys.view(np.int64)), "value": pa.array(np.concatenate([np.zeros(0), *value]))})

    dealt_out = strings_.withColumn("task", F.pmod(F.xxhash64(F.shiftright("key", 8 * (DEPTH - TOP + 1))), F.lit(tasks)))
    needed = dealt_out.select("task", F.shiftright("key", 8 * (DEPTH - 1)).cast("int").alias("context")).distinct()
    side = needed.join(two.drop("weighted"), "context")
    side = side.toDF(*side.columns)  # columns of its own, as both sides come from the same strings
    found = dealt_out.groupBy("task").cogroup(side.groupBy("task")).applyInArrow(predictions, "key long, value double")
    values = checkpoint(found.unionAll(words.select("key", F.col("n").cast("double").alias("value"))))
    del every, words, strings_, sums, two, one, dealt_out, needed, side, found
    release(spark)
    n_blocks = max(1, -(-int(size) // BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))).repartition(max(n_blocks, 2), "block")
    asked = dealt.mapInArrow(tidy(_distinct), "key long, block long").join(values, "key").select("block", "key", "value")
    schema = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, code_length double".format(docs.schema["doc_id"].dataType.simpleString())
    return dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_scored((n_all, n_distinct)), schema)


def op8_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)
