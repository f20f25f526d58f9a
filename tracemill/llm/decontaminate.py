"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a block of documents of bounded bytes. Its words become numbers of the benchmark's vocabulary; other words cannot be part
of a benchmark phrase, so only stretches of known words that are long enough for some phrase are indexed, each behind a separator. The index is the Burrows-Wheeler
transform of that sequence in a wavelet matrix, with suffix positions sampled at every eighth place and at the start of each stretch.
All phrases of a benchmark block are searched backwards at once; their occurrences are located by walking to the next sample, and
overlapping ones merge into removal spans. Documents are neither shuffled nor joined; the benchmark goes to the tasks in
blocks of bounded bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.arrow import blocks, tidy, with_columns
from tracemill.llm.common import checkpoint, table

WINDOW, SAMPLE = 10, 8
#: Text bytes of a benchmark block, and of a shard.
PHRASE_BYTES, SHARD_BYTES = 4 << 20, 8 << 20
#: Lower-cases A-Z; every ASCII byte that is neither a digit nor a letter separates words.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Phrases:
    """The distinct windows of some benchmark items, as numbers, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + window]), set()).add(k)
        self.length = np.fromiter(map(len, found), np.int64, len(found))
        self.symbols = np.zeros((len(found), window), np.int64)  # reversed, as they are searched
        for row, w in enumerate(found):
            self.symbols[row, : len(w)] = w[::-1]
        self.of = [sorted(x) for x in found.values()]
        self.least = int(self.length.min(initial=window))


class FMIndex:
    """Backward search and location in a sequence of symbols; 0 separates, and no pattern holds it.

    ``sequence`` ends in 0. Separators count as different from each other when suffixes are sorted, so no suffix is
    compared beyond its stretch.
    """

    def __init__(self, sequence: np.ndarray, sample: int = SAMPLE):
        n = len(sequence)
        gaps = sequence == 0
        n_gaps = int(gaps.sum())
        rank = np.where(gaps, np.cumsum(gaps) - 1, sequence + n_gaps)
        step = 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (max(int(rank.max()), n) + 2) + second
            order = np.argsort(key, kind="stable")
            new = np.r_[0, np.cumsum(key[order[1:]] != key[order[:-1]])]
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1 or step >= n:
                break
            step *= 2
        self.n = n
        last = sequence[order - 1]  # the transform: what stands before each suffix
        most = int(sequence.max())
        self.below = np.r_[0, np.cumsum(np.bincount(sequence, minlength=most + 1))]
        self.levels = max(1, most.bit_length())
        self.zeros, rows = [], last
        self.start = np.zeros(most + 1, np.int64)  # where each symbol begins after the last level
        symbols = np.arange(most + 1)
        for level in range(self.levels - 1, -1, -1):
            bit = (rows >> level) & 1
            zeros = np.zeros(n + 1, np.int32)
            np.cumsum(1 - bit, out=zeros[1:])
            self.zeros.append(zeros)
            ones = (symbols >> level) & 1 == 1
            self.start = np.where(ones, zeros[-1] + self.start - zeros[self.start], zeros[self.start])
            rows = np.concatenate([rows[bit == 0], rows[bit == 1]])
        self.last = last
        keep = (np.arange(n) % sample == 0) | np.r_[True, gaps[:-1]]
        self.sampled = np.where(keep[order], order, -1)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before row i."""
        for at, zeros in enumerate(self.zeros):
            z = zeros[i]
            i = np.where((symbol >> (self.levels - 1 - at)) & 1 == 1, zeros[-1] + i - z, z)
        return i - self.start[symbol]

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffixes begin with each pattern (rows of reversed symbols): from, to."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        known = len(self.below) - 1
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1]):
            live = live[(length[live] > k) & (hi[live] > lo[live])]
            c = patterns[live, k]
            absent = c >= known
            hi[live[absent]] = lo[live[absent]]
            live, c = live[~absent], c[~absent]
            lo[live], hi[live] = self.below[c] + self.rank(c, lo[live]), self.below[c] + self.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes at ``rows``."""
        out, walked = self.sampled[rows], np.zeros(len(rows), np.int64)
        todo, at = np.flatnonzero(out < 0), rows.copy()
        while len(todo):
            c = self.last[at[todo]]
            at[todo] = self.below[c] + self.rank(c, at[todo])
            walked[todo] += 1
            got = self.sampled[at[todo]]
            out[todo] = got
            todo = todo[got < 0]
        return out + walked


def stretches(ids: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of known words within a document that have ``least`` words or more: symbols with 0 after each run, and
    for each of them the number of the word."""
    n = len(ids)
    known = ids > 0
    edge = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (doc[1:] != doc[:-1]), True])
    run = np.repeat(np.diff(edge), np.diff(edge)) if n else np.zeros(0, np.int64)
    keep = known & (run >= least)
    place = np.flatnonzero(keep)
    ends = np.flatnonzero(np.r_[(place[1:] != place[:-1] + 1) | (doc[place[1:]] != doc[place[:-1]]), True]) if len(place) else np.zeros(0, np.int64)
    symbols = np.insert(ids[place], ends + 1, 0)
    return symbols, np.insert(place, ends + 1, -1)


def search_shard(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; document, first word in it, length and phrase of each occurrence."""
    get = phrases.number.get
    parts = [[get(w, 0) for w in words(t)] for t in texts]
    n_words = np.fromiter(map(len, parts), np.int64, len(parts))
    ids = np.fromiter((i for p in parts for i in p), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(len(texts)), n_words)
    symbols, place = stretches(ids, doc, phrases.least)
    none = np.zeros(0, np.int64)
    if not len(symbols) or not len(phrases.length):
        return n_words, none, none, none, none
    index = FMIndex(symbols)
    lo, hi = index.search(phrases.symbols, phrases.length)
    count = hi - lo
    phrase = np.repeat(np.arange(len(lo)), count)
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    word = place[index.locate(rows)]
    first = np.cumsum(n_words) - n_words
    return n_words, doc[word], word - first[doc[word]], phrases.length[phrase], phrase


def merged(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Word spans [from, to) that overlap or touch, as one each."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), (starts + lengths).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Find the windows of benchmark items in whole documents.

    Adds n_words, hit_spans (merged spans of word numbers, end exclusive) and hit_items (distinct item ids as strings,
    sorted). The text and all other columns stay; columns with a result's name are replaced. A null or wordless text has no
    words and no hits; benchmark rows without words find nothing; an item that stands there twice counts once, and one without id counts in spans only.
    """
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text") + 100), F.lit(0))).first()[0]
    n = max(1, -(-size // PHRASE_BYTES))
    docs = docs.withColumn("n_words", F.lit(0).cast("long")).withColumn("hit_spans", F.array().cast(SPAN)).withColumn("hit_items", F.array().cast("array<string>"))
    for k in range(n):  # one block as a rule
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases([(r.id, bytes(r.text)) for r in part.collect()]))
        docs = docs.mapInArrow(tidy(_searcher(phrases, docs.columns, text)), docs.schema)
        if k < n - 1:
            # one block is in memory at a time
            docs = checkpoint(docs)
            phrases.destroy()
    return docs


def _searcher(phrases, order: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = phrases.value
        for rest, texts in blocks(_copied(batches, text), "_bytes", SHARD_BYTES):
            n_words, doc, start, length, phrase = search_shard(texts, known)
            spans = rest.column(rest.schema.get_field_index("hit_spans")).to_pylist()
            items = rest.column(rest.schema.get_field_index("hit_items")).to_pylist()
            by = np.argsort(doc, kind="stable")
            cuts = np.flatnonzero(np.r_[True, doc[by][1:] != doc[by][:-1]]) if len(by) else []
            for at in np.split(by, cuts[1:]) if len(by) else []:
                d = int(doc[at[0]])
                old = [(s["start"], s["end"]) for s in spans[d]]
                a, b = np.r_[start[at], [x for x, _ in old]].astype(np.int64), np.r_[length[at], [y - x for x, y in old]].astype(np.int64)
                spans[d] = [{"start": x, "end": y} for x, y in merged(a, b)]
                own = {known.items[i] for p in np.unique(phrase[at]).tolist() for i in known.of[p]} - {None}
                items[d] = sorted(own | set(items[d]))
            new = {"n_words": pa.array(n_words, pa.int64()), "hit_spans": pa.array(spans, rest.schema.field("hit_spans").type), "hit_items": pa.array(items, rest.schema.field("hit_items").type)}
            yield with_columns(rest.drop_columns(list(new)), new).select(order)

    return run


def _copied(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("_bytes", b.column(b.schema.get_field_index(text)).cast(pa.binary()))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span."""
    at = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with every benchmark passage cut out of the texts (and n_chars to match); other documents stay as they are, and so do
    columns of any name."""

    @F.pandas_udf("string")
    def without(text, spans):
        return text.combine(spans, lambda t, s: cut(t.encode(), [(x["start"], x["end"]) for x in s]).decode())

    out = hits(docs.select(F.struct(*docs.columns).alias("row"), "text"), benchmark)
    clean = F.size("hit_spans") == 0
    out = out.select("row", clean.alias("clean"), F.when(clean, F.col("text")).otherwise(without(F.when(~clean, F.col("text")).otherwise(""), "hit_spans")).alias("text"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("clean"), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(row.alias("row")).select("row.*")


def op3_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
