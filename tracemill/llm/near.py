"""Near-duplicates by Order MinHash, verified by banded alignment.

Texts become words (A-Z lower-cased), words become overlapping shingles of five, and each shingle is labelled with its occurrence number. For
each of ``BANDS`` hash functions a sketch takes the ``PICKED`` labelled shingles with the least hashes and keeps them in text order, so that it
is sensitive to order as well as to content. Texts that share a sketch are candidates. The similarity of two
texts is measured by an alignment of their shingle sequences: A matched in order, A / (shingles of both - A), and it must be 0.8 or
more. Such an alignment never strays further from the diagonal than a ninth of both lengths, so only that band is aligned.

Equal texts are one node. Candidates are compared in two passes, both in units of bounded bytes that stream through tasks:

1. Each bucket's leader, the text that shares most sketches with others, is compared with all members. A bucket of thousands of copies
   is one class after that.
2. Buckets that still hold several classes are compared completely, but for pairs of one class. Large ones are cut into blocks, and each pair of
   blocks is a unit, so that no bucket is too large for a task and no candidate is left out. In a unit, bit maps of shingles rule out pairs
   by an exact bound, and pairs whose classes an earlier link has joined are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import hashing
from tracemill.llm.arrow import blocks, tidy, with_columns
from tracemill.llm.common import checkpoint, table
from tracemill.llm.decontaminate import FOLD
from tracemill.llm.hashing import mix

SHINGLE, BANDS, PICKED = 5, 24, 5
#: Similarity of at least 4/5.
NUMERATOR, DENOMINATOR = 4, 5
#: Shingles of a block of a unit.
BLOCK = 1 << 19
#: Longs of bit maps that are compared at once.
STEP = 1 << 19
_rng = np.random.default_rng(20)
_ODD = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_SEED = _rng.integers(0, 2**64, (BANDS, 1), np.uint64)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    hashes, n = hashing.word_hashes([t.translate(FOLD) for t in texts])
    return np.split(hashes, np.cumsum(n)[:-1])


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of k words; one of all words if there are fewer; none without words."""
    k = min(k, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    return mix(sum(words[i : i + n] * _ODD[i] for i in range(k)))


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles mixed with how often each has occurred before."""
    order = np.argsort(s, kind="stable")
    same = np.r_[False, s[order][1:] == s[order][:-1]]
    if not same.any():
        return s
    i = np.arange(len(s))
    number = np.empty(len(s), np.uint64)
    number[order] = i - np.maximum.accumulate(np.where(same, 0, i))
    return mix(s + number * _ODD[40])


def picked(n: int) -> int:
    return max(1, min(PICKED, n // 4))


def sketches(s: np.ndarray) -> np.ndarray:
    """The Order MinHash sketches of a text's shingles. Short texts take fewer shingles into a sketch; texts of similar
    length meet, as each also makes the sketches of the lengths that may be similar to its own."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    s = labelled(s)
    sizes = sorted({min(picked(m), n) for m in range(n * NUMERATOR // DENOMINATOR, -(-n * DENOMINATOR // NUMERATOR) + 1)}) if n < 8 * PICKED else [PICKED]
    out = []
    step = max(1, (1 << 20) // n)  # hash functions at once
    for lo in range(0, BANDS, step):
        h = mix(s[None, :] ^ _SEED[lo : lo + step])
        for size in sizes:
            at = np.sort(np.argpartition(h, size - 1, axis=1)[:, :size], axis=1) if size < n else np.broadcast_to(np.arange(n), (len(h), n))
            got = (s[at] * _ODD[8 : 8 + size]).sum(axis=1, dtype=np.uint64)
            out.append(mix(got + np.full(1, size, np.uint64) * _ODD[41] + np.arange(lo, lo + len(h), dtype=np.uint64) * _ODD[42]))
    return np.unique(np.concatenate(out)).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two shingle sequences is 0.8 or more, by bit-parallel alignment inside the band."""
    na, nb = len(a), len(b)
    need = -(-NUMERATOR * (na + nb) // (NUMERATOR + DENOMINATOR))  # of shingles matched in order
    if need > min(na, nb):
        return False
    if na == nb and np.array_equal(a, b):
        return True
    m = min(na, nb)
    differ = np.flatnonzero(a[:m] != b[:m])
    front = int(differ[0]) if len(differ) else m
    a, b = a[front:], b[front:]
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    tail = int(differ[0]) if len(differ) else m
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    need -= front + tail
    if need <= 0:
        return True
    # no alignment matches more than the common shingles
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if int(np.minimum(ca[ia], cb[ib]).sum()) < need:
        return False
    k = len(a) + len(b) - 2 * need  # unmatched shingles allowed: the alignment stays within k of the diagonal
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        where.setdefault(x, []).append(j)
    windows = {x: Window(places) for x, places in where.items() if len(places) > 16}
    width = 2 * k + 1
    full = (1 << width) - 1
    v, matched = full, 0  # bit t stands for place i - k + t of b; a 0 is a match gained
    for i, x in enumerate(a.tolist()):
        if i:
            matched += ~v & 1
            v = v >> 1 | 1 << (width - 1)
        places = where.get(x)
        if places:
            bits = 0
            if x in windows:
                bits = windows[x].bits(i - k, i + k)
            else:
                for j in places:
                    t = j - i + k
                    if 0 <= t < width:
                        bits |= 1 << t
            if bits:
                u = v & bits
                v = ((v + u) | (v - u)) & full
    return matched + width - v.bit_count() >= need


class Window:
    """The places of a frequent shingle as one integer that moves on with the band: each place enters it once."""

    def __init__(self, places: list[int]):
        self.places, self.entered, self.start, self.held = places, 0, 0, 0

    def bits(self, lo: int, hi: int) -> int:
        """Places from lo to hi, as bits from lo on; both only grow from call to call."""
        if lo > self.start:
            self.held >>= lo - self.start
            self.start = lo
        places, at = self.places, self.entered
        while at < len(places) and places[at] <= hi:
            if places[at] >= self.start:
                self.held |= 1 << (places[at] - self.start)
            at += 1
        self.entered = at
        return self.held << (self.start - lo)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (names the text: equal for equal texts only), n shingles and the sketches of every row."""
    rows = docs.select("doc_id", _key().alias("key"), "text")
    schema = rows.drop("text").withColumn("n", F.lit(0)).withColumn("sketches", F.array().cast("array<bigint>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in blocks(batches, "text", 4 << 20):
            s = [shingles(w) for w in word_hashes(texts)]
            yield with_columns(rest, {"n": pa.array(map(len, s), pa.int32()), "sketches": pa.array([sketches(x) for x in s], pa.list_(pa.int64()))})

    return rows.mapInArrow(tidy(run), schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], least_bytes: int = 4 << 20) -> Iterator[tuple[pa.Table, list[bytes], list[int]]]:
    """Whole groups of consecutive rows with equal ``keys``: their rows, texts, and where each group begins (and the end)."""
    held, texts = [], []

    def starts() -> list[int]:
        columns = [pa.chunked_array([b.column(b.schema.get_field_index(k)) for b in held]).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        return [k for k in range(len(rows)) if not k or rows[k] != rows[k - 1]]

    for rest, own in blocks(batches, "text", least_bytes):
        held.append(rest)
        texts += own
        at = starts()
        if len(at) > 1:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, at[-1]), texts[: at[-1]], at
            held, texts = whole.slice(at[-1]).to_batches(), texts[at[-1] :]
    if texts:
        at = starts()
        yield pa.Table.from_batches(held), texts, [*at, len(texts)]


class Maps:
    """Bit maps of texts' labelled shingles: of 2^k longs, at least four bits for each shingle, so that texts whose lengths may be similar have maps of
    the same size or of half of it. Bits common to two maps and the shingles lost in one bound the shingles in common."""

    def __init__(self, shingled: list[np.ndarray]):
        self.n = np.fromiter(map(len, shingled), np.int64, len(shingled))
        self.size = np.array([1 << max(4, (int(x) // 16).bit_length()) for x in self.n])
        self.rows: dict[int, np.ndarray] = {}  # by size: the texts with maps of that size or, folded, of twice that
        self.bits: dict[int, np.ndarray] = {}
        self.lost: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        own = {size: [] for size in {*self.size.tolist(), *(self.size // 2).tolist()}}
        for i, s in enumerate(shingled):
            on = np.zeros(64 * self.size[i], bool)
            on[(labelled(s) & np.uint64(len(on) - 1)).astype(np.int64)] = True
            own[int(self.size[i])].append((i, np.packbits(on, bitorder="little").view(np.uint64)))
        for size in own:
            rows = own[size] + [(i, b[:size] | b[size:]) for i, b in own.get(2 * size, [])]
            if not rows:
                continue
            self.rows[size] = np.array([i for i, _ in rows])
            self.bits[size] = np.stack([b for _, b in rows])
            self.lost[size] = self.n[self.rows[size]] - np.bitwise_count(self.bits[size]).sum(axis=1, dtype=np.int64)
            self.place[size] = np.zeros(len(shingled), np.int64)
            self.place[size][self.rows[size]] = np.arange(len(rows))

    def partners(self, x: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the texts marked in ``among`` that may be similar to x, by length and maps, and the bound of their shingles in common."""
        found, bound = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n = self.n[x]
        for size in (self.size[x] // 2, self.size[x]):
            if size not in self.rows:
                continue
            at = self.rows[size]
            may = among[at] & (NUMERATOR * self.n[at] <= DENOMINATOR * n) & (NUMERATOR * n <= DENOMINATOR * self.n[at])
            may &= (self.size[at] == size) | (size == self.size[x])
            may = np.flatnonzero(may)
            own = self.place[size][x]
            for part in np.split(may, range(STEP // size, len(may), STEP // size)):
                common = np.bitwise_count(self.bits[size][part] & self.bits[size][own]).sum(axis=1, dtype=np.int64) + np.minimum(self.lost[size][part], self.lost[size][own])
                fits = (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (self.n[at[part]] + n)
                found.append(at[part[fits]])
                bound.append(common[fits])
        return np.concatenate(found), np.concatenate(bound)


def links_of(shingled: list[np.ndarray], label: list[bytes], side: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """Similar pairs that join the classes of some texts; only of different sides, if there are sides. Pairs whose classes are joined already,
    directly or by others, are not compared; all others are, unless their lengths or maps rule it out."""
    parent = {x: x for x in label}

    def root(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    n = [len(s) for s in shingled]
    maps = Maps(shingled) if len(shingled) > 8 else None
    every = range(len(shingled))
    among = np.ones(len(n), bool)
    if side is not None:  # from the smaller side to the other
        among = side == side[0]
        if 2 * among.sum() < len(n):
            among = ~among
        every = np.flatnonzero(~among).tolist()
    for x in every:
        if side is None:
            among[x] = False  # pairs come up once
        if maps:
            others, bound = maps.partners(x, among)
            others = others[np.argsort(-bound, kind="stable")].tolist()
        else:
            others = [y for y in np.flatnonzero(among).tolist() if NUMERATOR * n[y] <= DENOMINATOR * n[x] and NUMERATOR * n[x] <= DENOMINATOR * n[y]]
        for y in others:
            if (a := root(label[x])) != (b := root(label[y])) and aligned(shingled[x], shingled[y]):
                parent[a] = b
                yield x, y


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) found in each unit (u, i, j): of different sides, or of all rows where i = j."""
    for rows, texts, starts in runs(batches, ["u", "i", "j"]):
        shingled = [shingles(w) for w in word_hashes(texts)]
        node, label = rows.column("node").to_pylist(), rows.column("label").to_pylist()
        side, whole = rows.column("side").to_numpy(), (rows.column("i").to_numpy() == rows.column("j").to_numpy())
        found = [(node[lo + x], node[lo + y]) for lo, hi in zip(starts, starts[1:], strict=False) for x, y in links_of(shingled[lo:hi], label[lo:hi], None if whole[lo] else side[lo:hi])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], ["a", "b"])


def linked(units: DataFrame, body: DataFrame) -> DataFrame:
    """Compare the texts of each unit: rows u, i, j, node, label, side; of blocks i and j if they differ."""
    dealt = units.join(body, "node").repartition(_tasks(units), "u", "i", "j").sortWithinPartitions("u", "i", "j")
    return checkpoint(dealt.mapInArrow(tidy(_compared), "a binary, b binary"))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b): the least node that can be reached.

    Each turn labels a node with the least of itself and its neighbours and goes on with the links between labels, which are about half as many nodes at
    most; turns grow with the logarithm of the longest path. Nodes with least names in the middle of their stars end in one.
    """
    edges = checkpoint(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    turns = []
    while edges.count():
        least = checkpoint(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
        turns.append(least)
        at = lambda c: least.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))  # noqa: B023, E731
        edges = checkpoint(edges.join(at("a"), "a").join(at("b"), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    if not turns:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = turns[0]
    for turn in turns[1:]:
        then = turn.select(F.col("node").alias("label"), F.col("label").alias("to"))
        out = out.join(then, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return checkpoint(out)


def _texts(docs: DataFrame, nodes: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """(node, text) of the nodes, from a row with each one's text and id ``rep``."""
    named = docs.select(F.col("doc_id").alias("rep"), _key().alias("key"), "text")
    side = nodes.select(F.col("key").alias("_key"), F.col("rep").alias("_rep"), "node")
    if side.limit(most_rows + 1).count() <= most_rows:
        side = F.broadcast(side)
    found = named.join(side, (F.col("key") == F.col("_key")) & F.col("rep").eqNullSafe(F.col("_rep")))
    return found.select("node", "text").dropDuplicates(["node"])


def _key():
    """Names a text: equal for equal texts only, null as the empty one."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _stars(members: DataFrame) -> DataFrame:
    """Units in which each bucket's leader meets the bucket's members."""
    lead = members.groupBy("sketch").agg(F.min(F.struct("node", "n")).alias("lead"))
    near = (F.col("n") * NUMERATOR <= F.col("lead.n") * DENOMINATOR) & (F.col("lead.n") * NUMERATOR <= F.col("n") * DENOMINATOR)
    pairs = members.join(checkpoint(lead), "sketch").where((F.col("node") != F.col("lead.node")) & near)
    pairs = checkpoint(pairs.select(F.col("lead.node").alias("u"), "node", "n").distinct())
    total = checkpoint(pairs.groupBy("u").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = pairs.join(total, "u").select("u", F.lit(-1).alias("i"), block.alias("j"), "node", F.col("node").alias("label"), F.lit(1).alias("side"))
    leads = total.select("u", F.lit(-1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.col("u").alias("node"), F.col("u").alias("label"), F.lit(0).alias("side"))
    return rows.unionAll(leads)


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Units of the buckets that hold several classes, without their leaders, which have met all. Of buckets with the same members one
    is enough."""
    now = checkpoint(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    own = now.groupBy("sketch").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("lead"), F.count(F.lit(1)).alias("size"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"),
        *[F.expr(f"bit_xor(xxhash64({k}, node))").alias(f"set{k}") for k in (1, 2)],
    )
    own = own.where("lo <> hi and size > 2").groupBy("set1", "set2", "size").agg(F.min(F.struct("sketch", "lead", "blocks")).alias("x")).select("x.*")
    rows = now.join(checkpoint(own), "sketch").where("node <> lead").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.col("sketch").alias("u"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "label", "side")


def _classified(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, key, class_id, n_texts and ``stays`` (its text and id are the class's first)."""
    rows = checkpoint(sketched(docs))
    texts = checkpoint(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketches").alias("sketches")))
    spread = texts.select("key", F.explode("sketches").alias("sketch"))
    shared = checkpoint(spread.groupBy("sketch").agg(F.count(F.lit(1)).alias("g")).where("g > 1"))
    members = checkpoint(spread.join(shared, "sketch"))
    # a text that shares more sketches with more others is nearer to the middle of its group; its name is less, and it leads
    first = F.unhex(F.lpad(F.hex(F.lit(1 << 62) - F.col("weight")), 16, "0"))
    nodes = members.groupBy("key").agg(F.sum("g").alias("weight")).select("key", F.concat(first, "key").alias("node"))
    nodes = checkpoint(texts.select("key", "rep", "n").join(nodes, "key"))
    members = checkpoint(members.select("sketch", "key").join(nodes.select("key", "node", "n"), "key").select("sketch", "node", "n"))
    body = checkpoint(_texts(docs, nodes))
    links = linked(_stars(members), body)
    more = linked(_open(members, components(links)), body)
    labels = components(links.unionAll(more))
    named = checkpoint(labels.join(nodes.select("key", "node", "rep"), "node").select("key", "rep", "label"))
    of = named.groupBy("label").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    named = named.join(of, "label")
    first = named.where(F.col("rep").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("key").alias("first"))
    named = named.join(first, "label").select("key", "class_id", "n_texts", (F.col("key") == F.col("first")).alias("first"))
    named = texts.select("key", "rep").join(named, "key", "left")
    class_id = F.when(F.col("n_texts").isNull(), F.col("rep")).otherwise(F.col("class_id"))
    # written, so that both sides of the last join are dealt by key, and a text with a large share of the rows is split
    named = checkpoint(named.select("key", "rep", class_id.alias("class_id"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"), F.coalesce("first", F.lit(True)).alias("first")))
    stays = F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep"))
    return rows.select("doc_id", "key").join(named, "key").select("doc_id", "key", "class_id", "n_texts", stays.alias("stays"))


def classes(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, class_id (the least doc_id of its class) and n_texts, the
    different texts of the class.

    Equal texts are always in one class; texts without words, and null (as an empty text), only with their equals. Null ids
    come after all others as class ids. Extra columns are not looked at.
    """
    return _classified(docs).select("doc_id", "class_id", "n_texts")


def deduped(docs: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """One document of each class: the row with the least id (one row of those, if ids repeat), with all its columns."""
    found = checkpoint(_classified(docs).groupBy("doc_id", "key", "stays").agg(F.count(F.lit(1)).alias("rows")))
    left = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), _key().alias("key"))
    drop = found.where("not stays").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"))
    if drop.limit(most_rows + 1).count() <= most_rows:
        drop = F.broadcast(drop)
    left = left.join(drop, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_doc")), "left_anti")
    twice = found.where("stays and rows > 1").select("key")
    if twice.count():
        again = left.join(twice, "key", "left_semi").dropDuplicates(["key"])
        left = left.join(twice, "key", "left_anti").select("row").unionAll(again.select("row"))
    return left.select("row.*")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
