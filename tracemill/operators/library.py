"""Probe design: word tables, candidate probes, their hits, gates and placement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import dna
from tracemill.operators import words


def word_table(sequences: DataFrame, k: int, seq: str = "seq", clip: int | None = 65535) -> DataFrame:
    """word -> occurrences over all windows of all sequences, clipped."""
    n = F.sum("n")  # of what the tasks have counted
    return words.counted(sequences, k, seq).groupBy("word").agg((F.least(n, F.lit(clip)) if clip else n).cast("long").alias("n"))


def hits(probes: DataFrame, words: DataFrame, k: int, uid: str, seq: str = "seq", reverse: bool = False) -> DataFrame:
    """Sum of the table's counts over the words of each probe, or of its reverse complement."""
    s = dna.reverse_complement(F.col(seq)) if reverse else F.col(seq)
    own = probes.select(uid, F.explode_outer(dna.kmers(s, k)).alias("word"))
    return own.join(words, "word", "left").groupBy(uid).agg(F.sum(F.coalesce("n", F.lit(0))).alias("hits"))


def both_hits(probes: DataFrame, words: DataFrame, k: int, uid: str, seq: str = "seq") -> DataFrame:
    """``hits`` of each probe and of its reverse complement (reverse_hits), by one join with the table."""
    strands = F.array(*[F.struct(F.lit(x).alias("strand"), s.alias("s")) for x, s in enumerate((F.col(seq), dna.reverse_complement(F.col(seq))))])
    own = probes.select(uid, F.inline(strands)).select(uid, "strand", F.explode_outer(dna.kmers(F.col("s"), k)).alias("word"))
    n = F.coalesce("n", F.lit(0))
    of = lambda x: F.sum(F.when(F.col("strand") == x, n).otherwise(0))
    return own.join(words, "word", "left").groupBy(uid).agg(of(0).alias("hits"), of(1).alias("reverse_hits"))


def candidates(sequences: DataFrame, length: int, uid: str, seq: str = "seq", size: int = 128) -> DataFrame:
    """Every window of a sequence: uid, start (0-based), seq. Sequences are cut into pieces first, a row each."""
    size = max(size, 2 * length)
    pieces = sequences.select(uid, F.posexplode(dna.tiles(F.col(seq), length, size)).alias("_n", "_t")).where(F.length("_t") >= length)
    at = F.explode(F.sequence(F.lit(0), F.length("_t") - length))
    windows = pieces.select(uid, "_n", "_t", at.alias("_at"))
    return windows.select(uid, (F.col("_n") * size + F.col("_at")).alias("start"), F.substring(F.col("_t"), F.col("_at") + 1, F.lit(length)).alias("seq"))


def gated(probes: DataFrame, gc: tuple[float, float], tm: tuple[float, float]) -> DataFrame:
    """Probes of plain bases whose GC share and melting temperature are within closed ranges, with both."""
    out = probes.where(dna.valid(F.col("seq"))).withColumn("gc", dna.gc(F.col("seq"))).where(F.col("gc").between(*gc))
    return out.withColumn("tm", dna.melting_temperature(F.col("seq"))).where(F.col("tm").between(*tm))


def placed(probes: DataFrame, region: str, length: int, space: int = 0) -> DataFrame:
    """Take probes of a region by falling score (ties: lower start) where none taken is nearer than ``length + space``.
    Sequential, so a grouped kernel: a group is one region's candidates."""

    def take(df: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect, insort

        taken: list[int] = []
        rows = []
        df = df.sort_values(["score", "start"], ascending=[False, True], kind="stable")
        for i, s in zip(df.index, df["start"], strict=True):
            k = bisect(taken, s)
            if (not k or s - taken[k - 1] >= length + space) and (k == len(taken) or taken[k] - s >= length + space):
                insort(taken, s)
                rows.append(i)
        return df.loc[rows]

    return probes.groupBy(region).applyInPandas(take, probes.schema)


def fewest_hits(probes: DataFrame, region: str, n: int, uid: str) -> DataFrame:
    w = Window.partitionBy(region).orderBy("hits", uid)
    return probes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def nearest_to(probes: DataFrame, region: str, anchor: str, n: int, size: float | None = None) -> DataFrame:
    """The n probes of each region nearest to its left end, middle or right end (ties: lower start). With ``size``, all within size / 2 of it if they are n or more."""
    span = probes.groupBy(region).agg(F.min("start").alias("_lo"), F.max("start").alias("_hi"))
    at = {"left": F.col("_lo"), "right": F.col("_hi"), "mid": (F.col("_lo") + F.col("_hi")) / 2}[anchor]
    out = probes.join(span, region).withColumn("_d", F.abs(F.col("start") - at))
    out = out.withColumn("_n", F.row_number().over(Window.partitionBy(region).orderBy("_d", "start")))
    return out.where((F.col("_n") <= n) | (F.col("_d") <= size / 2) if size is not None else F.col("_n") <= n).select(*probes.columns)


def shared_words(sequences: DataFrame, k: int, uid: str, seq: str = "seq") -> DataFrame:
    """Pairs a > b of sequences that share words, counting both strands of b: distinct words of a found in b."""
    fwd = sequences.select(F.col(uid).alias("a"), F.explode(F.array_distinct(dna.kmers(F.col(seq), k))).alias("word"))
    both = F.array_distinct(F.concat(dna.kmers(F.col(seq), k), dna.kmers(dna.reverse_complement(F.col(seq)), k)))
    rev = sequences.select(F.col(uid).alias("b"), F.explode(both).alias("word"))
    return fwd.join(rev, "word").where("a > b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def region_sizes(probes: DataFrame, region: str, least: int) -> DataFrame:
    """Regions with fewer probes than ``least``."""
    return probes.groupBy(region).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def readout_use(probes: DataFrame, region: str, readouts: Column) -> DataFrame:
    """Per readout: probes and regions that carry it."""
    return probes.select(region, F.explode(readouts).alias("readout")).groupBy("readout").agg(F.count(F.lit(1)).alias("probes"), F.count_distinct(region).alias("regions"))


def flags(exons: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Runs of positions with equal flags, the flag being the product of the weights of the interval kinds (gene, kind, start, end
    inclusive) that cover a position. Intervals are cut at all ends, so no position is listed."""
    ends = exons.select("gene", F.explode(F.array("start", F.col("end") + 1)).alias("at")).distinct()
    by = Window.partitionBy("gene").orderBy("at")
    cuts = ends.withColumn("to", F.lead("at").over(by) - 1).where("to is not null")
    inside = cuts.join(exons.select("gene", "kind", "start", "end").distinct(), "gene").where("start <= at and end >= to")
    weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    kinds = inside.groupBy("gene", "at", "to").agg(F.collect_set("kind").alias("kinds"))
    flag = F.aggregate("kinds", F.lit(1), lambda a, k: a * F.coalesce(F.element_at(weight, k), F.lit(1)))
    pieces = kinds.withColumn("flag", flag)
    change = F.when((F.lag("flag").over(by) == F.col("flag")) & (F.lag("to").over(by) + 1 == F.col("at")), 0).otherwise(1)
    run = pieces.withColumn("_c", change).withColumn("run", F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("gene", "run").agg(F.min("at").alias("start"), F.max("to").alias("end"), F.first("flag").alias("flag")).drop("run")


def blast_counts(hits: DataFrame, probe: str, hard: int = 30, soft: int = 17) -> DataFrame:
    """Per probe the alignments (length, score) that reach the hard and the soft limit in both."""
    reach = lambda n: F.sum(F.when((F.col("length") >= n) & (F.col("score") >= n), 1).otherwise(0))
    return hits.groupBy(probe).agg(reach(hard).alias("hard"), reach(soft).alias("soft"))


def screened(probes: DataFrame, counts: DataFrame, region: str, uid: str, n: int, mode: str = "center", most_soft: int = 30, least_share: float = 0.75) -> DataFrame:
    """Probes with one or two hard hits and few soft ones; where enough would be left, only those with one. Of more than ``n`` in a region those
    nearest to its middle stay, or its first, or its last ones."""
    ok = probes.join(counts, uid, "left").where(F.col("hard").between(1, 2) & (F.col("soft") <= most_soft))
    left, once = F.count(F.lit(1)), F.sum(F.when(F.col("hard") == 1, 1).otherwise(0))
    enough = ok.groupBy(region).agg(((once >= least_share * left) & (left >= least_share * n)).alias("_once"))
    ok = ok.join(enough, region).where(~F.col("_once") | (F.col("hard") == 1)).drop("_once", "hard", "soft")
    span = probes.groupBy(region).agg(F.max("start").alias("_hi"), F.min("start").alias("_lo"))
    rank = {"center": [F.abs(F.col("start") - (F.col("_lo") + F.col("_hi")) / 2), F.col("start")], "front": [F.col("start")], "end": [F.col("start").desc()]}[mode]
    w = Window.partitionBy(region).orderBy(*rank, uid)
    return ok.join(span, region).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select(*probes.columns)


def not_overlapping(probes: DataFrame, region: str) -> DataFrame:
    """Of the first two neighbours (by start) that overlap the earlier goes, until none do. A group is one region."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["start", "end"], kind="stable")
        stack: list[int] = []
        for i, start in enumerate(df["start"]):
            while stack and df["end"].iloc[stack[-1]] > start:
                stack.pop()
            stack.append(i)
        return df.iloc[stack]

    return probes.groupBy(region).applyInPandas(run, probes.schema)


def extracted(regions: DataFrame, genome: DataFrame) -> DataFrame:
    """The bases of regions (chr, start, end: from 1, both ends belong; strand - gives the reverse complement) out of chromosomes (chr, seq), which stand
    in blocks (chr, first, seq) so that a row is never a whole chromosome: see ``blocked``."""
    width = 1 << 16
    at = F.explode(F.sequence(F.floor((F.greatest(F.lit(1), "start") - 1) / width), F.floor((F.col("end") - 1) / width)))
    asked = regions.where("start <= end").select(*regions.columns, at.alias("_b"))
    parts = asked.join(genome.select("chr", F.floor((F.col("first") - 1) / width).alias("_b"), "first", "seq"), ["chr", "_b"])
    lo = F.greatest(F.col("start"), F.col("first")) - F.col("first") + 1
    hi = F.least(F.col("end"), F.col("first") + F.length("seq") - 1) - F.col("first") + 1
    piece = F.substring(F.col("seq"), lo.cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int"))
    got = parts.select(*regions.columns, "first", piece.alias("piece")).groupBy(*regions.columns).agg(F.array_sort(F.collect_list(F.struct("first", "piece"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    if "strand" in regions.columns:
        whole = F.when(F.col("strand") == "-", dna.reverse_complement(whole)).otherwise(whole)
    return got.select(*regions.columns, whole.alias("seq"))


def blocked(sequences: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Chromosomes (chr, seq) as blocks: chr, first (from 1), seq."""
    cut = F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("_n", "seq")
    return sequences.select("chr", cut).select("chr", (F.col("_n").cast("long") * width + 1).alias("first"), "seq")


def start_sites(genes: DataFrame, flank: int) -> DataFrame:
    """Regions about transcription starts: the start on the + strand, the end on the - strand, ``flank`` to either side."""
    at = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))
    return genes.withColumns({"start": F.greatest(F.lit(1), at - flank), "end": at + flank})


def shortest_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """What all intervals of a group share: the positions that each of its transcripts covers, as intervals. parts: keys, transcript, start, end."""
    n = parts.groupBy(*keys).agg(F.count_distinct("transcript").alias("_all"))
    ends = parts.select(*keys, F.explode(F.array("start", F.col("end") + 1)).alias("at")).distinct()
    by = Window.partitionBy(*keys).orderBy("at")
    cuts = ends.withColumn("to", F.lead("at").over(by) - 1).where("to is not null")
    cover = cuts.join(parts, keys).where("start <= at and end >= to").groupBy(*keys, "at", "to").agg(F.count_distinct("transcript").alias("n")).join(n, keys).where("n = _all")
    run = cover.withColumn("_c", F.when(F.lag("to").over(by) + 1 == F.col("at"), 0).otherwise(1))
    run = run.withColumn("run", F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "run").agg(F.min("at").alias("start"), F.max("to").alias("end")).drop("run")


def introns(exons: DataFrame, keys: list[str]) -> DataFrame:
    """The gaps between a transcript's exons (start and end belong to them)."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    gaps = exons.withColumn("_reach", reach).where(F.col("start") > F.col("_reach") + 1)
    return gaps.select(*keys, (F.col("_reach") + 1).alias("start"), (F.col("start") - 1).alias("end"))
