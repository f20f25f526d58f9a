"""Sharding by balanced label propagation. DataFrame functions only.

Documents with equal texts are linked. Shards take ``rows`` within one of each other, so each has a quota. After an even start in id order,
each round lets every group rank the shards by how many of its members they hold; members move to the first of
these, and those of a group larger than a quota to the following ones, a quota's worth to each. A shard accepts
movers, larger groups first, up to its quota; all others fill the places that are left, groups still side by side. Rounds end when no
fewer links are cut.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import checkpoint, ranked, table

SHARDS = 40


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (k < n % shards) for k in range(shards)]


def place(position: Column, room: list[int]) -> Column:
    """The shard of a position when shards are filled one after the other with as many rows as they have room for."""
    ends = list(accumulate(room))
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= position))


def cut(docs: DataFrame) -> int:
    """Links cut: members of a group that are not in the shard that holds most of it."""
    in_shard = docs.where("size_g > 1").groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n"))
    return in_shard.groupBy("g").agg((F.sum("n") - F.max("n")).alias("cut")).agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]


def move(docs: DataFrame, room: list[int]) -> DataFrame:
    """One round: docs has id columns, g (group), size_g, k (number within the group) and shard."""
    quota = max(max(room), 1)
    linked = docs.where("size_g > 1")
    # at most one row for each shard and group
    by = Window.partitionBy("g").orderBy(F.col("n").desc(), F.xxhash64("g", "shard"))
    wish = linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("choice", F.row_number().over(by) - 1).select("g", "choice", F.col("shard").alias("to"))
    wish = checkpoint(wish)  # written, as sizes below: joins with a written side are dealt out by key on both, so that a large group is split
    wishes = linked.withColumn("choice", F.floor(F.col("k") / quota).cast("int")).join(wish, ["g", "choice"], "left").drop("choice")
    wishes = wishes.withColumn("large", -F.col("size_g"))
    claims = ranked(wishes, ["to"], ["large", "g", "k"], "claim")
    capacity = F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), F.col("to") + 1)
    claims = checkpoint(claims.withColumn("in", F.coalesce(F.col("claim") < capacity, F.lit(False))))
    taken = {r.to: r.n for r in claims.where("in").groupBy("to").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shard
    left = [r - taken.get(s, 0) for s, r in enumerate(room)]
    own = docs.columns
    rest = claims.where("not in").select(*own).unionAll(docs.where("size_g = 1"))
    rest = ranked(rest.withColumn("large", -F.col("size_g")), [], ["large", "g", "k", "doc_id"], "position")
    rest = rest.withColumn("shard", place(F.col("position"), left)).select(*own)
    return checkpoint(claims.where("in").withColumn("shard", F.col("to")).select(*own).unionAll(rest))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deal all rows of ``docs`` (doc_id, text) into ``shards``, counts at most one apart, equal texts together as far as that allows.

    Returns doc_id, size (UTF-8 bytes + 16; null text: 16), text_crc32, shard and slot (0, 1, ... within the shard, in order of
    group and id). Null texts have crc 0 and are equal to the empty text. Ties and repeated rows are rows of their own; an empty
    table gives none. Extra columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("g"))
    rows = ranked(rows, ["g"], ["doc_id", "size"], "k")
    rows = checkpoint(rows)
    sizes = checkpoint(rows.groupBy("g").agg(F.count(F.lit(1)).alias("size_g")).where("size_g > 1"))
    rows = rows.join(sizes, "g", "left").withColumn("size_g", F.coalesce("size_g", F.lit(1)))
    n = docs.count()
    room = quotas(n, shards)
    now = ranked(rows, [], ["doc_id", "g", "k"], "start").withColumn("shard", (F.col("start") % shards).cast("int")).drop("start")
    now = checkpoint(now)
    best = cut(now)
    while best:  # each round that counts cuts fewer links
        then = move(now, room)
        after = cut(then)
        if after >= best:
            break
        now, best = then, after
    out = ranked(now, ["shard"], ["g", "k", "doc_id"], "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


def op4_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
