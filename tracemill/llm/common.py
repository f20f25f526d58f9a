"""Pieces that the text operators share."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space and \\t \\n \\v \\f \\r.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. Where a session on one machine has none, as in
    tests, a temporary folder becomes it; on a cluster that is refused, as executors would not see each other's files."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tracemill-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there. The JVM's cleaner deletes the files of frames that are
    out of reach, if the session asks for that."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Ask for a collection, after which Spark deletes the shuffles and checkpoints of frames that are out of reach."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null ids: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def join_table(df: DataFrame, side: DataFrame, keys: list[str], most_rows: int = 50_000, salts: int = 64) -> DataFrame:
    """``df`` left-joined to a table that has one row per key; null keys match each other.

    The side is counted first. Up to ``most_rows`` it is broadcast; beyond, both sides are shuffled by the key and a
    salt, so that a key with a large share of the rows is spread over ``salts`` tasks.
    """
    side = checkpoint(side).withColumnsRenamed({k: f"_side_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_side_{k}")) for k in keys]
    gone = [f"_side_{k}" for k in keys]
    if side.limit(most_rows + 1).count() <= most_rows:
        return df.join(F.broadcast(side), on, "left").drop(*gone)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    right = side.withColumn("_side_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*on, F.col("_salt") == F.col("_side_salt")], "left").drop(*gone, "_salt", "_side_salt")


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group 0, 1, ... in the given order, however large a group is.

    Range partitions cut within groups. Each task numbers its own rows; a group's rows in a task count from the first of
    them. Only groups that go on from one task to the next are shifted by their rows before: no more of those than tasks,
    so that they are broadcast. ``order`` should end in something nearly unique so that ranges can be cut.
    """
    keys = [F.col(c) for c in (*groups, *order)]
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cut = df.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys)
    cut = checkpoint(cut.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    stats = cut.groupBy("_part", *groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a group's rows lie in consecutive tasks: this window has as many rows as a group has tasks
    before = Window.partitionBy(*groups or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.sum("_n").over(before)).drop("_n")
    if groups:
        cut = cut.withColumn("_first", F.min("_at").over(Window.partitionBy("_part", *groups)))
        stats = stats.drop("_first").where("_before > 0")
    stats = stats.withColumnsRenamed({c: f"_s{c}" for c in ("_part", *groups)})
    on = [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in ("_part", *groups)]
    out = cut.join(F.broadcast(stats), on, "left")
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.coalesce("_before", F.lit(0))).select(*df.columns, name)
