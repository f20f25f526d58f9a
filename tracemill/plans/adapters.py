"""The driver's tables as spots, traces, regions, peaks, codes and sequences, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spots(spark: SparkSession, d: str) -> DataFrame:
    e = lambda k: f"1000 * cast(embedding[{k}] as double)"
    return table(spark, d, "embeddings").selectExpr(
        "vec_id as uid", "label as cell_id", "cast(vec_id % 12 as int) as bit", "concat('ch', vec_id % 3) as channel", f"{e(0)} as z", f"{e(1)} as x", f"{e(2)} as y",
        "1000 * (1 + abs(cast(embedding[3] as double))) as height", "100 * (1 + abs(cast(embedding[4] as double))) as background", "cast(vec_id % 5 as int) as region",
    )


SPOTS = """spots as (select vec_id as uid, label as cell_id, (vec_id % 12)::int as bit, 'ch' || (vec_id % 3) as channel, 1000 * embedding[1]::double as z, 1000 * embedding[2]::double as x,
  1000 * embedding[3]::double as y, 1000 * (1 + abs(embedding[4]::double)) as height, 100 * (1 + abs(embedding[5]::double)) as background, (vec_id % 5)::int as region from embeddings)"""

#: region -> bits of the inline codebook
CODES = {0: (0, 3, 7), 1: (0, 3, 8), 2: (1, 4, 9), 3: (1, 5, 10), 4: (2, 6, 11), 5: (2, 7, 9)}


def codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, b) for r, bits in CODES.items() for b in bits], "region_id int, bit int")


CODES_SQL = "codes as (select * from (values " + ", ".join(f"({r}, {b})" for r, bits in CODES.items() for b in bits) + ") v(region_id, bit))"
VALID_SQL = "valid as (select a.bit as bit_a, b.bit as bit_b, min(a.region_id) as region_id from codes a join codes b on a.region_id = b.region_id and a.bit < b.bit group by 1, 2)"


def traces(spark: SparkSession, d: str) -> DataFrame:
    """One copy a user; an error is a region without a place."""
    ev = table(spark, d, "events")
    place = lambda e, n: f"case when event_type <> 'error' then {e} end as {n}"
    return ev.selectExpr(
        "user_id as copy", "event_id", "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as region", place("value", "z"), place("cast(event_id % 97 as double)", "x"),
        place("cast(event_id % 89 as double)", "y"), "case when event_type in ('view', 'click') then 'A' else 'B' end as label", "concat('chr', event_id % 3) as chr",
    )


TRACES = """traces as (select user_id as copy, event_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as region, case when event_type <> 'error' then value end as z,
  case when event_type <> 'error' then (event_id % 97)::double end as x, case when event_type <> 'error' then (event_id % 89)::double end as y,
  case when event_type in ('view', 'click') then 'A' else 'B' end as label, 'chr' || (event_id % 3) as chr from events)"""
PAIRS = TRACES + """, pairs as (select a.copy, a.region as i, b.region as j, sqrt((a.z - b.z) ** 2 + (a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d
  from traces a join traces b on a.copy = b.copy and a.region < b.region)"""


def regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey as id", "concat('chr', p_size % 5) as chr", "1000 * p_partkey as start", "1000 * p_partkey + 1000 + p_size * 40 as end")


REGIONS = "regions as (select p_partkey as id, 'chr' || (p_size % 5) as chr, 1000 * p_partkey as start, 1000 * p_partkey + 1000 + p_size * 40 as \"end\" from part)"


def peaks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as id", "concat('chr', l_suppkey % 5) as chr", "1000 * l_partkey + l_linenumber * 125 as midpoint", "l_quantity as fold",
        "1000 * l_partkey + l_linenumber * 125 - 300 as start", "1000 * l_partkey + l_linenumber * 125 + 300 as end",
    )


PEAKS = """peaks as (select l_orderkey * 10 + l_linenumber as id, 'chr' || (l_suppkey % 5) as chr, 1000 * l_partkey + l_linenumber * 125 as midpoint, l_quantity as fold,
  1000 * l_partkey + l_linenumber * 125 - 300 as start, 1000 * l_partkey + l_linenumber * 125 + 300 as "end" from lineitem)"""

_FROM, _TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def sequences(spark: SparkSession, d: str, name: str = "benchmark", uid: str = "item_id") -> DataFrame:
    """Letters of a text (others dropped before upper-casing), dealt onto the four bases."""
    return table(spark, d, name).select(F.col(uid).alias("uid"), F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), _FROM, _TO).alias("seq"))


def sequences_sql(name: str = "benchmark", uid: str = "item_id", alias: str = "sequences") -> str:
    return f"{alias} as (select {uid} as uid, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_FROM}', '{_TO}') as seq from {name})"


def words_sql(k: int, of: str = "sequences", alias: str = "words") -> str:
    return f"{alias} as (select uid, substr(seq, s, {k}) as word from (select uid, seq, unnest(range(1, length(seq) - {k} + 2)) as s from {of}))"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_nationkey as fov_id", "c_custkey as cell_id", "c_acctbal as x", "cast(c_custkey % 101 as double) as y", "0.0D as z")


CELLS = "cells as (select c_nationkey as fov_id, c_custkey as cell_id, c_acctbal as x, (c_custkey % 101)::double as y, 0.0 as z from customer)"
