"""Quality rules with thresholds that adapt to language and source. DataFrame functions only.

Each document yields a few integer rates. For every (lang, source) a quantile sketch of each rate is built: a histogram
whose buckets keep the six leading bits of the value, so a bucket is at most 1/32 wide relative to its start. Such sketches
merge by adding counts, hence exactly and in any order: partial sums before the shuffle, sums over sources for a language,
sums over all for the corpus. A source with too few documents uses its language's thresholds, then the corpus's. The
threshold is a fence far outside the middle of the group, ``median + REACH * (q75 - median)``: ordinary spread rejects nothing, up to a
quarter of junk in a group does not move it, and groups of different spread get different fences. Where a quarter of the documents agree with the
median (as with duplicate lines, which most documents have none of), or nearly so, a least distance (``GUARD``) takes the place of the spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import SPACES, checkpoint, join_table, table

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Punctuation marks.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: rate -> least distance of the fence from the median, in the rate's unit
GUARD = {"mark_rate": 200, "dup_line_rate": 3000, "capital_rate": 200, "word_length": 50}
#: rate -> what it relates to what, and its scale
RATES = {"mark_rate": ("n_marks", "word_chars", 10000), "dup_line_rate": ("n_dup_lines", "n_lines", 10000), "capital_rate": ("n_capitals", "word_chars", 10000), "word_length": ("word_chars", "n_words", 100)}
CAPITALS, WHITE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[ \t\n\x0B\f\r]+"
REACH, LEAST_DOCS = 40, 200
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30


def _rate(a: str, b: str, scale: int) -> Column:
    return F.expr(f"case when {b} > 0 then {scale} * {a} div {b} end")


def _without(t: Column, characters: str) -> Column:
    """Code points of a text beside some ASCII characters. (Runs are cut out by a pattern, in half the time of a translation.)"""
    return F.length(F.regexp_replace(t, "[" + "".join(f"\\x{ord(c):02x}" for c in characters) + "]+", "")).cast("long")


def _count(t: Column, characters: str) -> Column:
    return F.length(t).cast("long") - _without(t, characters)


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))


def rates(docs: DataFrame) -> DataFrame:
    """lang, source and the rates that the sketches need of each document, without the counts that only the base rule needs."""
    t = F.coalesce("text", F.lit(""))
    chars = _without(t, SPACES).alias("word_chars")
    words = F.size(F.array_remove(F.split(t, WHITE), "")).cast("long").alias("n_words")
    df = docs.select("lang", "source", _lines(t).alias("_lines"), chars, _count(t, CAPITALS).alias("n_capitals"), _count(t, MARKS).alias("n_marks"), words)
    lines = F.size("_lines").cast("long")
    df = df.select("lang", "source", "word_chars", "n_capitals", "n_marks", "n_words", lines.alias("n_lines"), (lines - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"))
    return df.select("lang", "source", *[_rate(*how).alias(r) for r, how in RATES.items()])


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and rates of each document; a null text counts as one without words.

    Words are runs of anything but space, \\t, \\n, \\v, \\f, \\r. n_repeat_words: words in eight-word windows that occur twice
    or more in the text. Windows are compared by a 64-bit hash of their words, first among each other as a set, and in
    sorted order only where that shows a repeat.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    split, lines = F.array_remove(F.split(t, WHITE), ""), _lines(t)
    df = docs.withColumn("_words", split).withColumn("_lines", lines)
    n = F.size("_words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    w = F.col("_windows")
    order = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_order", F.when(F.size(F.array_distinct(w)) < F.size(w), order).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    o = F.col("_order")

    def same(i: Column, step: int) -> Column:
        return F.coalesce(F.get(o, i + step)["h"] == F.get(o, i)["h"], F.lit(False))

    twice = F.array_sort(F.transform(F.filter(F.transform(o, lambda x, i: F.struct(x["i"].alias("i"), (same(i, -1) | same(i, 1)).alias("r"))), lambda x: x["r"]), lambda x: x["i"]))
    df = df.withColumn("_twice", twice)
    # each window adds the words that the window before, if it is near, has not covered
    covered = F.aggregate(F.transform("_twice", lambda x, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get("_twice", i - 1)))), F.lit(0).cast("long"), lambda a, x: a + x)
    counts = F.struct(
        n.cast("long").alias("n_words"),
        _without(t, SPACES).alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        _count(t, CAPITALS).alias("n_capitals"),
        _count(t, MARKS).alias("n_marks"),
        covered.alias("n_repeat_words"),
    )
    # as a generator's output the counts are computed once, and filters on them are not rewritten into filters on the text
    df = df.select(*docs.columns, F.inline(F.array(counts)))
    df = df.withColumns({r: _rate(*how) for r, how in RATES.items()})
    return df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def sketches(own_rates: DataFrame, names: list[str]) -> DataFrame:
    """Per lang, source and rate: counts of the buckets, named by their smallest value."""
    long = own_rates.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(x).alias("rate"), F.col(x).alias("v")) for x in names])).alias("x")).select("lang", "source", "x.rate", "x.v")
    drop = "greatest(length(bin(v)) - 6, 0)"
    return long.where("v is not null").groupBy("lang", "source", "rate", F.expr(f"shiftleft(shiftright(v, {drop}), {drop})").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _fences(merged: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """One row per key: documents and the fence of each rate. A window here holds the buckets of one sketch, under 2,000."""
    by = [*keys, "rate"]
    upto = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    q = merged.withColumn("below", F.sum("n").over(upto)).withColumn("docs", F.sum("n").over(Window.partitionBy(*by)))
    at = lambda p: F.min(F.when(100 * F.col("below") >= p * F.col("docs"), F.col("bucket")))
    q = q.groupBy(*by).agg(at(50).alias("q50"), at(75).alias("q75"), F.max("docs").alias("docs"))
    guard = reduce(lambda e, kv: e.when(F.col("rate") == kv[0], kv[1]), GUARD.items(), F.when(F.lit(False), 0))
    q = q.withColumn("fence", F.col("q50") + F.greatest(reach * (F.col("q75") - F.col("q50")), guard))
    return q.groupBy(*keys).agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("rate") == r, F.col("fence"))).alias(f"most_{r}") for r in GUARD])


def thresholds(own_rates: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The fences that hold for each (lang, source): its own, its language's or the corpus's, by the number of documents."""
    own = checkpoint(sketches(own_rates, list(GUARD)))
    lang = own.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    whole = own.groupBy("rate", "bucket").agg(F.sum("n").alias("n"))
    a, b = _fences(own, ["lang", "source"], reach).alias("a"), _fences(lang, ["lang"], reach).alias("b")
    c = _fences(whole.withColumn("one", F.lit(1)), ["one"], reach).alias("c")
    pick = lambda r: F.when(F.col("a.docs") >= least_docs, F.col(f"a.{r}")).when(F.col("b.docs") >= least_docs, F.col(f"b.{r}")).otherwise(F.col(f"c.{r}"))
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang"))).join(F.broadcast(c))  # c is one row
    return joined.select("a.lang", "a.source", *[pick(f"most_{r}").alias(f"most_{r}") for r in GUARD])


def verdicts(scored: DataFrame, fences: DataFrame) -> DataFrame:
    """Features with the fences that hold for each document, and ``kept``."""
    joined = join_table(scored, fences, ["lang", "source"])
    inside = reduce(Column.__and__, [F.coalesce(F.col(r) <= F.col(f"most_{r}"), F.lit(True)) for r in GUARD])
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def judged(docs: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with its features, ``base_failed`` and ``kept``.

    Needs columns text, lang, source; null lang or source is a group of its own; other columns pass through unless they
    have a feature's name, in which case the feature replaces them. Texts without words fail the base rule. An empty table
    gives an empty result.
    """
    return verdicts(features(docs.drop(*_ADDED)), thresholds(rates(docs), reach, least_docs))


_ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_capitals", "n_marks", "n_repeat_words", "base_failed", "kept", *GUARD, *[f"most_{r}" for r in GUARD]]


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with, whatever their names."""
    return judged(docs.select("text", "lang", "source", F.struct(*docs.columns).alias("row"))).where("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = checkpoint(features(docs).drop("text"))  # counts only: the texts are read once
    out = verdicts(scored, thresholds(scored))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
