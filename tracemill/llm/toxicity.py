"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals make document scores and offending offsets.

1. Over all labelled training documents, Spark counts in how many toxic and other documents each word and each word's beginning and ending
   (four and three bytes) stands. Those that stand in a fixed number of toxic documents and are several times likelier there are the lexicon. It
   grows with the corpus and stays a distributed table: blocks of texts are joined with the entries among their own distinct words.
2. A token's observations are the strengths of its word, beginning and ending, those of its two neighbours, and its shape (case, digits, other
   scripts, length). On a bounded sample of labelled documents the field is fitted to what document labels say about tokens: none of a clean document is
   toxic, and at least one of a toxic document is. Its gradient spreads each toxic label over the document's tokens by expectation, the
   marginals given that not all tokens are clean; words' own strengths are hidden at random, so that the rest counts for unseen words.
3. Every text is tagged by forward-backward; a logistic function of the marginals (their sum, their share, the greatest) gives
   the document's probability, and runs of marginals over one half are the offending spans.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.arrow import blocks, tidy, with_columns
from tracemill.llm.common import checkpoint, crc_mod, release, table
from tracemill.llm.decontaminate import FOLD, WORD

#: Least number of toxic documents in which a lexicon entry stands, at any size of the corpus; least log odds.
LEAST_DOCS, LEAST_ODDS = 5, 2.0
STEPS = (2.0, 3.5, 5.0)  # of log odds: an entry's strength is the number of steps it reaches
BEGINNING, ENDING, STRENGTHS = 4, 3, 4
#: Values of each observation: strengths of word, beginning, ending, word before and word after; shape; length.
VALUES = (STRENGTHS,) * 5 + (6, 4)
#: The labelled sample that field and logistic function are fitted to: documents of each label, and their characters together.
SAMPLE, SAMPLE_CHARS = 500, 1_500_000
#: Text bytes of the pieces in which the driver goes through the sample; a piece is larger only if it is one document.
FIT_BYTES = 1 << 18
PREDICT = 0.3
#: Text bytes of a block that is joined with its entries, and of the pieces in which it is tagged; bits of the sieve, a power of two.
JOIN_BYTES, TAG_BYTES, SIEVE_BITS = 4 << 20, 4 << 20, 1 << 24


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def entries(own: set[bytes]) -> set[bytes]:
    """Words with the entries for their beginnings and endings."""
    return own | {b"^" + w[:BEGINNING] for w in own} | {b"$" + w[-ENDING:] for w in own}


class Strengths(dict):
    """word -> its strength and those of its beginning and ending as one number, looked up once for each distinct word."""

    def __init__(self, strength: dict[bytes, int]):
        super().__init__()
        self.of = strength.get

    def __missing__(self, word: bytes) -> int:
        code = self[word] = (self.of(word, 0) * STRENGTHS + self.of(b"^" + word[:BEGINNING], 0)) * STRENGTHS + self.of(b"$" + word[-ENDING:], 0)
        return code


@dataclass
class Field:
    emission: list[np.ndarray]  # for each observation, the ln odds that its values add for the toxic tag
    bias: float
    switch: np.ndarray  # ln potentials of tag pairs [from, to]
    logistic: np.ndarray  # for 1, ln(1 + sum), share, greatest


@dataclass
class Model:
    lexicon: DataFrame  # entry, strength; of any size
    field: Field


def products(m: np.ndarray) -> np.ndarray:
    """Vectors v[t] ~ m[t] m[t-1] ... m[0] 1, each scaled to sum 1, for a sequence of 2x2 matrices.

    The sequence is cut into chunks, about nine times as many as each has steps, that advance side by side, first as products, then as vectors.
    """
    n = len(m)
    if not n:
        return np.zeros((0, 2))
    size = int(np.ceil(np.sqrt(n) / 3))
    chunks = -(-n // size)
    whole = np.zeros((2, 2, chunks * size))
    whole[0, 0, n:] = whole[1, 1, n:] = 1
    whole[:, :, :n] = m.transpose(1, 2, 0)
    whole = np.ascontiguousarray(whole.reshape(2, 2, chunks, size).transpose(3, 0, 1, 2))  # [step, to, from, chunk]
    (p, q), (r, s) = whole[0]
    for (a, b), (c, d) in whole[1:]:
        p, q, r, s = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        f = 1 / (p + q + r + s)
        p, q, r, s = p * f, q * f, r * f, s * f
    x, y = np.empty(chunks), np.empty(chunks)
    u = w = 0.5
    for k, (a, b, c, d) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        x[k], y[k] = u, w
        u, w = a * u + b * w, c * u + d * w
        f = u + w
        u, w = u / f, w / f
    out = np.empty((size, 2, chunks))
    for k, ((a, b), (c, d)) in enumerate(whole):
        x, y = a * x + b * y, c * x + d * y
        f = 1 / (x + y)
        x, y = x * f, y * f
        out[k, 0], out[k, 1] = x, y
    return np.ascontiguousarray(out.transpose(2, 0, 1)).reshape(-1, 2)[:n]


def shapes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of every token: its shape (lower case, one capital first, capitals only, with digits, with bytes beyond ASCII, other), and its length
    (up to 3, 6, 10 or more bytes)."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = np.frombuffer(FOLD, np.uint8)[joined] != 32
    edges = np.flatnonzero(np.r_[inside[0], inside[1:] != inside[:-1]])
    start, length = edges[::2], np.diff(edges)[::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    upper, digit, beyond = (joined >= 65) & (joined <= 90), (joined >= 48) & (joined <= 57), joined >= 128
    # the bytes between words are neither upper case, digits nor beyond ASCII
    n_upper, n_digit, n_beyond = (np.add.reduceat(x, start, dtype=np.int64) for x in (upper, digit, beyond))
    shape = np.select([n_digit > 0, n_beyond > 0, n_upper == 0, (n_upper == 1) & upper[start], n_upper == length], [3, 4, 0, 1, 2], 5)
    return shape, np.searchsorted([4, 7, 11], length, side="right")


def features(code: np.ndarray, first: np.ndarray, shape: np.ndarray, size: np.ndarray) -> np.ndarray:
    """[tokens, observations]: see ``VALUES``; 0 beyond the text."""
    f = np.zeros((len(code), len(VALUES)), np.uint8)
    f[:, 0], f[:, 1], f[:, 2], f[:, 5], f[:, 6] = code // STRENGTHS**2, code // STRENGTHS % STRENGTHS, code % STRENGTHS, shape, size
    both = np.maximum(f[:, 0], f[:, 1])
    f[1:, 3] = np.where(first[1:], 0, both[:-1])
    f[:-1, 4] = np.where(first[1:], 0, both[1:])
    return f


def _matrices(score: np.ndarray, switch: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Step matrices [to, from]; the first token of a text forgets what was before."""
    e = np.stack([np.zeros(len(score)), score], axis=1)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    t = np.exp(switch - switch.max()).T
    return np.where(first[:, None, None], 1.0, t[None]) * e[:, :, None]


def forward_backward(score: np.ndarray, switch: np.ndarray, first: np.ndarray, steps: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic tag, and, with ``steps``, of the tag pairs [token, from, to] ending at each token (0 for first tokens)."""
    m = _matrices(score, switch, first)
    alpha = products(m)
    after = products(np.swapaxes(m, 1, 2)[::-1])[::-1]  # of what each token hands to the one before
    beta = np.full_like(alpha, 0.5)
    beta[:-1] = after[1:]
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    pairs = np.zeros((len(score) if steps else 0, 2, 2))
    if steps and len(score) > 1:
        joint = alpha[:-1, :, None] * np.swapaxes(m[1:], 1, 2) * beta[1:, None, :]
        pairs[1:] = np.where(first[1:, None, None], 0, joint / joint.sum(axis=(1, 2), keepdims=True))
    return p[:, 1], pairs


def clamped(p: np.ndarray, pairs: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tokens and pairs given the documents' labels (``toxic``: of each token's document): no toxic token in a clean one, at
    least one in a toxic one.

    All tokens are clean with the probability P0 of one path, a product of steps along the chain. Given that they are not, whatever holds a
    toxic token is 1 / (1 - P0) times as likely.
    """
    clean = np.maximum(1 - p, 1e-300)
    step = np.log(clean)
    step[1:] = np.where(first[1:], step[1:], np.log(np.maximum(pairs[1:, 0, 0], 1e-300)) - step[:-1])
    at = np.flatnonzero(first)
    size = np.diff(np.r_[at, len(p)])
    none = np.repeat(np.exp(np.minimum(np.add.reduceat(step, at), -1e-9)) if len(at) else np.zeros(0), size)
    some = np.where(toxic, 1 / (1 - none), 0.0)
    out = pairs * some[:, None, None]
    out[:, 0, 0] = np.where(toxic, (pairs[:, 0, 0] - none) * some, 1)
    out[first] = 0
    return np.minimum(p * some, 1), np.maximum(out, 0)


def fit_field(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.3) -> tuple[list[np.ndarray], float, np.ndarray]:
    """Maximise the likelihood of the documents' labels, with a small ridge, by Adam; it starts where strong words are toxic.

    ``parts``: features, labels and firsts of the tokens of whole documents. Chains are in memory for one part at a time, and their sums are added up.
    """
    cuts = np.cumsum(VALUES)
    theta = np.zeros(cuts[-1] + 1 + 4)
    theta[:STRENGTHS], theta[cuts[-1]] = 2.0 * np.arange(STRENGTHS), -5.0
    n = sum(len(f) for f, _, _ in parts)

    def expected(f: np.ndarray, p: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(f[:, k], p, v) for k, v in enumerate(VALUES)] + [[p.sum()], pairs.sum(axis=0).ravel()])

    def gain(f: np.ndarray, toxic: np.ndarray, first: np.ndarray) -> np.ndarray:
        emission, bias, switch = np.split(theta[: cuts[-1]], cuts[:-1]), theta[cuts[-1]], theta[-4:].reshape(2, 2)
        p, pairs = forward_backward(bias + sum(e[f[:, k]] for k, e in enumerate(emission)), switch, first)
        return expected(f, *clamped(p, pairs, first, toxic)) - expected(f, p, pairs)

    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        g = sum(gain(*part) for part in parts) / max(n, 1) * 100 - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return np.split(theta[: cuts[-1]], cuts[:-1]), float(theta[cuts[-1]]), theta[-4:].reshape(2, 2)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def tagged(texts: list[bytes], strength: dict[bytes, int], hide: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all tokens, tokens of each text, and which tokens are first. ``hide``: drop half the words' strengths."""
    split, held = [words(t) for t in texts], Strengths(strength)
    n = np.fromiter(map(len, split), np.int64, len(split))
    first = np.zeros(int(n.sum()), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    code = np.fromiter((held[x] for p in split for x in p), np.int64, len(first))
    if hide is not None:
        code = np.where(hide.random(len(code)) < 0.5, code, code % STRENGTHS**2)
    return features(code, first, *shapes(texts)), n, first


def marginals(f: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    return forward_backward(field.bias + sum(e[f[:, k]] for k, e in enumerate(field.emission)), field.switch, first, steps=False)[0]


def summaries(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each text's marginals: 1, ln(1 + sum), share, greatest; zeros for a text without words."""
    out = np.zeros((len(n), 4))
    out[:, 0] = 1
    some = n > 0
    at = (np.cumsum(n) - n)[some]
    if len(at):
        total = np.add.reduceat(p, at)
        out[some, 1], out[some, 2], out[some, 3] = np.log1p(total), total / n[some], np.maximum.reduceat(p, at)
    return out


def entries_of(texts: list[bytes]) -> list[bytes]:
    """The distinct words of texts, their beginnings and endings."""
    own: set[bytes] = set()
    for t in texts:
        own.update(words(t))
    return list(entries(own))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rest, texts in blocks(batches, "text", 8 << 20):
        toxic = rest.column(0).to_pylist()
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for t, x in zip(texts, toxic, strict=True):
            counts[x].update(entries(set(words(t))))
        names = list(counts[0] | counts[1])
        for lo in range(0, len(names), 1 << 16):
            part = names[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *[pa.array([c[w] for w in part], pa.int64()) for c in counts]], ["entry", "other", "toxic"])


def sample(docs: DataFrame) -> list[str]:
    """Texts in the order of a hash, long ones too: ``SAMPLE`` of them or ``SAMPLE_CHARS`` together; the last is cut there."""
    keys = docs.select(F.xxhash64(F.lit(1), "doc_id").alias("k0"), F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), "text")
    room, last, n = SAMPLE_CHARS, 0, 0
    # sizes first, so that tasks send no more texts than these
    for r in keys.select("k0", "k1", "k2", F.length("text").alias("chars")).orderBy("k0", "k1", "k2").limit(SAMPLE).collect():
        if room > 0:
            room, last, n = room - r.chars, r.k0, n + 1
    texts, room = [], SAMPLE_CHARS
    for r in keys.where(F.col("k0") <= last).withColumn("text", F.substring("text", 1, SAMPLE_CHARS)).orderBy("k0", "k1", "k2").limit(n).collect():
        texts.append(r.text[:room])
        room -= len(texts[-1])
    return texts


def runs(texts: list[bytes], most: int) -> Iterator[slice]:
    """Texts that follow each other, ``most`` bytes together at most or one text."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield slice(start, k)
            start, size = k, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def fitted(texts: list[bytes], y: np.ndarray, strength: dict[bytes, int], weight: np.ndarray) -> Field:
    """The field and its logistic function for texts with labels ``y``; besides a few bytes for each token, the driver holds one run of texts."""
    cut, hide = list(runs(texts, FIT_BYTES)), np.random.default_rng(1)
    plain = [tagged(texts[at], strength) for at in cut]
    hidden = [tagged(texts[at], strength, hide) for at in cut]
    parts = [(f, np.repeat(y[at] == 1, n), first) for at, (f, n, first) in zip(cut * 2, plain + hidden, strict=True)]
    field = Field(*fit_field(parts), np.zeros(4))
    field.logistic = fit_logistic(np.concatenate([summaries(marginals(f, first, field), n) for f, n, first in plain]), y, weight)
    return field


def fit(labelled: DataFrame) -> Model:
    """Fit to ``labelled`` (doc_id, text, toxic 0/1). Without toxic or without other documents the score is a constant. Repeated rows
    count as often as they stand there; ids serve for the order of the sample only, null ones too."""
    per = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = per.get(1, 0), per.get(0, 0)
    counts = labelled.select("toxic", "text").mapInArrow(tidy(_word_counts), "entry binary, other long, toxic long").groupBy("entry").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    entries = counts.withColumn("odds", odds).where((F.col("toxic") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
    strength = sum((F.col("odds") >= x).cast("int") for x in STEPS)
    field = Field([np.zeros(v) for v in VALUES], 0.0, np.zeros((2, 2)), np.zeros(4))
    model = Model(checkpoint(entries.select("entry", strength.alias("strength"))), field)
    if not n_toxic or not n_other:
        share = min(max((n_toxic + 0.5) / (n_toxic + n_other + 1), 0.01), 0.99)
        field.logistic[0] = np.log(share / (1 - share))
        return model
    rows = [(t, x) for x in (0, 1) for t in sample(labelled.where(F.col("toxic") == x))]
    y = np.array([x for _, x in rows], float)
    texts = [t.encode() for t, _ in rows]
    # of the lexicon only what the sample's own words hold comes to the driver
    own = labelled.sparkSession.createDataFrame(pa.table({"entry": pa.array(entries_of(texts), pa.binary())}))
    strength = {bytes(r.entry): r.strength for r in own.join(model.lexicon, "entry").collect()}
    weight = np.where(y == 1, n_toxic / y.sum(), n_other / (1 - y).sum())
    model.field = fitted(texts, y, strength, weight / weight.mean())
    return model


def sieve(lexicon: DataFrame) -> np.ndarray:
    """A bit map of the entries' checksums, of fixed size: most words that are no entry are seen by it before the join."""
    bit = F.crc32("entry") % SIEVE_BITS
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    held = lexicon.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(SIEVE_BITS // 64, np.int64)
    out[held.column("at").to_numpy()] = held.column("bits").to_numpy()
    return out


def joined(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``docs`` in blocks: packed (an Arrow stream of its rows) and found (the lexicon's rows among its words)."""
    bits = docs.sparkSession.sparkContext.broadcast(sieve(lexicon))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for rest, texts in blocks(batches, "text", JOIN_BYTES):
            names = entries_of(texts)
            h = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % SIEVE_BITS
            names = [names[k] for k in np.flatnonzero(bits.value[h >> 6] >> (h & 63) & 1)]
            whole = with_columns(rest, {"text": pa.array(texts, pa.large_binary())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_batch(whole)
            columns = [pa.array([block]), pa.array([names], pa.list_(pa.binary())), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "names", "packed"])
            block += 1

    # written once, so that a block is the same rows on both sides
    packed = checkpoint(docs.mapInArrow(tidy(pack), "block long, names array<binary>, packed binary"))
    found = packed.select("block", F.explode("names").alias("entry")).join(lexicon, "entry")
    found = found.groupBy("block").agg(F.collect_list(F.struct("entry", "strength")).alias("found"))
    return packed.select("block", "packed").join(found, "block", "left").select("packed", "found")


def spans(text: bytes, p: np.ndarray) -> list[dict[str, int]]:
    """Code-point offsets of runs of tokens that are likelier toxic than not."""
    out: list[list[int]] = []
    last = -2
    for k, m in enumerate(WORD.finditer(text.translate(FOLD))):
        if p[k] > 0.5:
            if k == last + 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = k
    done = chars = 0
    found = []
    for a, b in out:
        chars += len(text[done:a].decode(errors="replace"))
        start = chars
        chars += len(text[a:b].decode(errors="replace"))
        done = b
        found.append({"start": start, "end": chars})
    return found


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Replace ``text`` by score, predicted and spans (code-point offsets); other columns pass through, those with a result's name
    are replaced. Null and wordless texts get the score of a text without toxic tokens and no spans."""
    docs = docs.drop("score", "predicted", "spans")
    held = docs.sparkSession.sparkContext.broadcast(model.field)
    schema = docs.drop("text").selectExpr("*", "cast(0 as double) score", "0 predicted", "cast(null as array<struct<start: int, end: int>>) spans").schema

    def score(rest: pa.RecordBatch, texts: list[bytes], strength: dict[bytes, int]) -> pa.RecordBatch:
        field = held.value
        f, n, first = tagged(texts, strength)
        p = marginals(f, first, field)
        x = summaries(p, n)
        score = 1 / (1 + np.exp(-np.clip(x @ field.logistic, -30, 30)))
        at = np.cumsum(n) - n
        found = [spans(t, p[a : a + k]) if g > 0.5 else [] for t, a, k, g in zip(texts, at, n, x[:, 3], strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return with_columns(rest, {"score": pa.array(score), "predicted": pa.array(score >= PREDICT).cast(pa.int32()), "spans": pa.array(found, kind)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, found in zip(*batch.columns, strict=True):
                own = found.values
                strength = {} if own is None else dict(zip(own.field("entry").to_pylist(), own.field("strength").to_pylist(), strict=True))
                for rest, texts in blocks(pa.ipc.open_stream(packed.as_buffer()), "text", TAG_BYTES):
                    yield score(rest, texts, strength)

    return joined(docs, model.lexicon).mapInArrow(tidy(run), schema)


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column, most_rows: int = 200_000) -> DataFrame:
    """The documents outside ``held_out`` that have a label: doc_id, text, toxic. Of several labels of an id the greatest holds."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    if own.limit(most_rows + 1).count() <= most_rows:
        own = F.broadcast(own)
    return docs.where(~held_out).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(own, "doc_id")


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(labelled(docs, table(spark, sf_dir, "labels"), held_out))
    release(spark)  # the counts' shuffle
    return scored(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted", "spans")
