"""Line dedup: repeated runs of lines, found with a suffix array by distributed prefix doubling. DataFrame functions only.

The corpus is one sequence of line numbers; documents end it apart, and lines without words are no part of it. A suffix starts
at each line. Round k sorts the suffixes by their first 2^k lines: the rank of a suffix is the order of the pair (rank of its first
half, rank of what follows it 2^(k-1) lines on), as counted pairs sorted by range partitions. Only suffixes whose first 2^k lines
occur again go on, so each round has fewer. Suffixes that agree on their first L lines are an interval of the suffix array whose longest
common prefix is L or more; two ranks that overlap, of the first and the last 2^k <= L of the L lines, name it.

The maximal repeated runs are not listed one by one: their lines are found through their smallest parts, which name the same lines.
A line goes if it lies in a run of lines, of ``least_words`` words or more together, that starts at an earlier place
as well (earlier document id, or earlier in the document): the first copy of a run stays whole. Such runs are found from their smallest parts, the
shortest runs from each line onwards and up to each line that have the words; these cover exactly the maximal repeated runs.
No shortest run has more than ``least_words`` lines, which bounds the rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import SPACES, checkpoint, table

LEAST_WORDS = 50
DOC = ["d", "h"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text as d and h, which name a document: rows that agree in both are one. Whole numbers are ordered as such, other ids as strings; null ids come
    first."""
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    else:
        d = F.coalesce(F.concat(F.lit("1"), F.col("doc_id").cast("string")), F.lit("0"))
    return docs.withColumns({"d": d, "h": F.xxhash64("text")})


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def suffixes(docs: DataFrame) -> DataFrame:
    """The lines that occur again: document (d, h), number i among its lines with words, number in the text, words,
    ``seg`` (equal along lines that follow each other) and r0, the line's rank."""
    words = lambda x: F.size(F.array_remove(F.split(x, r"[ \t\n\x0B\f\r]+"), ""))
    of = F.filter(
        F.transform(_lines(F.col("text")), lambda x, n: F.struct(n.alias("line"), F.xxhash64(F.trim(x)).alias("x"), F.xxhash64(F.lit(7), F.trim(x)).alias("y"), words(x).alias("w"))), lambda s: s["w"] > 0
    )
    has = F.length(F.translate(F.coalesce("text", F.lit("")), SPACES, "")) > 0
    lines = _keyed(docs.select("doc_id", "text")).where(has).select(*DOC, of.alias("s")).dropDuplicates(DOC)
    lines = checkpoint(lines.select(*DOC, F.posexplode("s").alias("i", "s")).select(*DOC, "i", "s.*"))
    again = lines.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = lines.join(_in_order(again, ["x", "y"], "r0"), ["x", "y"]).select(*DOC, "i", "line", "w", "r0")
    seg = F.col("i") - F.row_number().over(Window.partitionBy(*DOC).orderBy("i"))
    return checkpoint(kept.withColumn("seg", seg))


def _in_order(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct keys with a number that grows with their order: of the range partition, then within it."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = keys.select(*by).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return cut.withColumn(name, F.monotonically_increasing_id())


def doubled(ranks: DataFrame, step: int) -> DataFrame:
    """From the ranks of the first ``step`` lines (d, h, seg, i, r) to those of twice as many, of suffixes that share
    them with another one."""
    w = Window.partitionBy(*DOC, "seg").orderBy("i").rangeBetween(step, step)
    pairs = ranks.withColumn("r2", F.first("r").over(w)).where("r2 is not null")
    again = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.join(_in_order(again, ["r", "r2"], "to"), ["r", "r2"]).select(*DOC, "seg", "i", F.col("to").alias("r"))


def shortest_runs(rows: DataFrame, least_words: int) -> DataFrame:
    """For each line, the shortest runs from it and up to it that have the words: first line i, lines n."""
    by = Window.partitionBy(*DOC, "seg").orderBy("i")

    def lines(ws: Column) -> Column:
        """How many values, from the front, add up to enough; null if all do not."""
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
        step = lambda a, x: F.when(a["sum"] >= least_words, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n")))
        return F.aggregate(ws, zero, step, lambda a: F.when(a["sum"] >= least_words, a["n"]))

    ahead = lines(F.collect_list("w").over(by.rowsBetween(0, least_words - 1)))
    back = lines(F.reverse(F.collect_list("w").over(by.rowsBetween(-(least_words - 1), 0))))
    both = rows.select(*DOC, "seg", "i", ahead.alias("ahead"), back.alias("back"))
    runs = F.array(F.struct(F.col("i").alias("i"), F.col("ahead").alias("n")), F.struct((F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("n")))
    out = both.select(*DOC, "seg", F.explode(runs).alias("run")).select(*DOC, "seg", "run.*").where("n is not null")
    return out.dropDuplicates([*DOC, "i", "n"])


def later_copies(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """From the repeated lines, the runs that start earlier elsewhere: document (d, h), first line i (among lines with words), lines n, and the
    document and line of the first copy."""
    runs = checkpoint(shortest_runs(rows, least_words))
    ranks, step, named = rows.select(*DOC, "seg", "i", F.col("r0").alias("r")), 1, []
    longest = runs.agg(F.max("n")).first()[0] or 0
    while step <= longest:
        here = runs.where((F.col("n") >= step) & (F.col("n") < 2 * step))
        first = ranks.select(*DOC, "i", F.col("r").alias("ra"))
        last = ranks.select(*DOC, F.col("i").alias("j"), F.col("r").alias("rb"))
        here = here.join(first, [*DOC, "i"]).withColumn("j", F.col("i") + F.col("n") - step).join(last, [*DOC, "j"])
        named.append(here.select(*DOC, "i", "n", "ra", "rb"))
        if 2 * step <= longest:
            ranks = checkpoint(doubled(ranks, step))
        step *= 2
    if not named:
        named = [runs.select(*DOC, "i", "n", F.lit(0).cast("long").alias("ra"), F.lit(0).cast("long").alias("rb"))]
    every = checkpoint(reduce(DataFrame.unionAll, named))
    interval = ["n", "ra", "rb"]
    first = every.groupBy(*interval).agg(F.min(F.struct("d", "h", "i")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = checkpoint(first)  # so that both sides of the join are dealt out by the run, and a run with a large share of the rows is split
    copies = every.join(first.drop("copies"), interval).where(F.struct("d", "h", "i") != F.col("first"))
    return copies.select(*DOC, "i", "n", F.col("first.d").alias("first_doc"), F.col("first.i").alias("first_i"))


def removals(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per document (d, h) with later copies: the sorted numbers, in the text, of the lines that go."""
    rows = suffixes(docs)
    gone = later_copies(rows, least_words).select(*DOC, F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("i")).distinct()
    return gone.join(rows.select(*DOC, "i", "line"), [*DOC, "i"]).groupBy(*DOC).agg(F.array_sort(F.collect_list("line")).alias("gone"))


def without(text: Column, gone: Column) -> Column:
    """The text without some of its lines. (The one-element array binds the split text, so that it is split once.)"""
    parts = F.struct(_lines(text).alias("p"), F.array_except(F.sequence(F.lit(0), F.size(_lines(text)) - 1), gone).alias("stay"))
    return F.transform(F.array(parts), lambda z: F.array_join(F.transform(z["stay"], lambda n: F.get(z["p"], n)), "\n"))[0]


def deduped(docs: DataFrame, least_words: int = LEAST_WORDS, lines: bool = False) -> DataFrame:
    """``docs`` with the later copies of repeated runs of lines cut out of ``text`` (and n_chars to match, where it changes).

    Documents that lose their last words go; null, empty and wordless texts stay as they are. Rows that repeat an id
    together with its text count as one document and all get its result. ``lines``: keep every row, and add n_lines and
    removed_lines (numbers of lines in the text, from 0), in place of columns of these names. Other columns pass through, whatever their names.
    """
    rows = _keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")).select("row", "text", *DOC)
    joined = rows.join(removals(docs, least_words), DOC, "left")
    hit = F.col("gone").isNotNull()
    text = F.when(hit, without(F.col("text"), F.col("gone"))).otherwise(F.col("text"))
    joined = joined.select("row", text.alias("text"), "gone")
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    if lines:
        n = F.size(_lines(F.col("row.text"))).cast("long")
        joined = joined.select(row.alias("row"), n.alias("n_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"))
        return joined.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "removed_lines")], "n_lines", "removed_lines")
    return joined.where(~hit | (F.length(F.translate("text", SPACES, "")) > 0)).select(row.alias("row")).select("row.*")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "documents").select("doc_id", "text"), lines=True)
