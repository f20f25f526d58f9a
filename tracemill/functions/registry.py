"""What SQL text can call: the DNA and score functions, and the table function ``kmers``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: SQL functions: they are inlined as expressions.
SQL = {
    "reverse_complement(s string) returns string": "reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))",
    "gc_share(s string) returns double": "length(regexp_replace(s, '[^GCgc]', '')) / length(s)",
    "pack_bases(s string) returns bigint": "cast(conv(translate(regexp_replace(upper(s), '[^ACGT]', 'A'), 'ACGT', '0123'), 4, 10) as bigint)",
    "log_distance_score(d double) returns double": "ln(d / 2000 + 1)",
    "exp_distance_score(d double) returns double": "-exp(d / 2000)",
    "distance3(z0 double, x0 double, y0 double, z1 double, x1 double, y1 double) returns double": "sqrt(power(z0 - z1, 2) + power(x0 - x1, 2) + power(y0 - y1, 2))",
}


@udtf(returnType="start int, word string")
class Kmers:
    """The words of a sequence with their places (from 0). ``operators.library.candidates`` is the same without Python."""

    def eval(self, seq: str, k: int) -> Iterator[tuple[int, str]]:
        for i in range(len(seq or "") - k + 1):
            yield i, seq[i : i + k]


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for head, body in SQL.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    spark.udtf.register("kmers", Kmers)
    return [*[h.split("(")[0] for h in SQL], "kmers"]


#: Reducers that a name may stand for, as aggregates; nulls are left out.
REDUCERS = {
    "nanmedian": lambda c: F.percentile(c, 0.5), "nanmean": F.avg, "nanstd": F.stddev_pop, "nanvar": F.var_pop, "nanmin": F.min, "nanmax": F.max, "nansum": F.sum, "count": F.count,
    "median": lambda c: F.percentile(c, 0.5), "mean": F.avg, "std": F.stddev_pop, "var": F.var_pop, "min": F.min, "max": F.max, "sum": F.sum,
}


def reducer(name: str, column: Column) -> Column:
    """The aggregate of a reducer's name; other names are refused."""
    if name not in REDUCERS:
        raise ValueError(f"no reducer {name!r}; there are {', '.join(sorted(REDUCERS))}")
    return REDUCERS[name](column)
