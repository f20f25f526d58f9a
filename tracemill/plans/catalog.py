"""The registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import dna, geometry, statistics
from tracemill.operators import aggregates, decode, domains, joins, library, merging, picking, windows
from tracemill.plans import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n)


D = "sqrt((a.z - b.z) ** 2 + (a.x - b.x) ** 2 + (a.y - b.y) ** 2)"

# ---- population maps and aggregates of traces ----


@query(f"with {A.PAIRS} select i, j, round(median(d), 6) as median, round(avg(d), 6) as mean, round(sum((d <= 50)::int) / count(d), 6) as contact, count(d) as n from pairs group by i, j")
def population_map(s, d):
    pairs = aggregates.pair_distances(A.traces(s, d), ["copy"], "region")
    out = aggregates.population_map(pairs, [], 50.0, ("median", "mean"))
    return out.select("i", "j", r("median").alias("median"), r("mean").alias("mean"), r("contact").alias("contact"), "n")


flagship = population_map


@query(f"""with {A.PAIRS} select i, j, round(sum((d <= 50)::int) / nullif(count(d), 0), 6) as closed, round(sum((d < 50)::int) / nullif(count(d), 0), 6) as open,
  round(sum((d < 50)::int) / nullif(sum((d <> 50)::int), 0), 6) as strict, round(coalesce(sum((d < 50)::int), 0) / count(*), 6) as null_is_far from pairs group by i, j""")
def contact_rules(s, d):
    p, c = aggregates.pair_distances(A.traces(s, d), ["copy"], "region"), F.col("d")
    how = {"closed": ("<=", "skip"), "open": ("<", "skip"), "strict": ("<>", "skip"), "null_is_far": ("<", "no")}
    return p.groupBy("i", "j").agg(*[r(aggregates.contact(c, 50.0, *v)).alias(k) for k, v in how.items()])


@query(f"with {A.TRACES} select copy, round(sqrt(var_pop(z) + var_pop(x) + var_pop(y)), 6) as rg, count(*) as n from traces where x is not null group by copy")
def radius_of_gyration(s, d):
    return aggregates.radius_of_gyration(A.traces(s, d), ["copy"]).select("copy", r("rg").alias("rg"), "n")


@query(f"""with {A.TRACES}, m as (select copy, median(z) as mz, median(x) as mx, median(y) as my from traces group by copy)
select copy, round(avg(sqrt((z - mz) ** 2 + (x - mx) ** 2 + (y - my) ** 2)), 6) as rg_median from traces join m using (copy) group by copy""")
def radius_about_median(s, d):
    return aggregates.radius_about_median(A.traces(s, d), ["copy"]).select("copy", r("rg_median").alias("rg_median"))


@query(f"with {A.TRACES} select copy, label, round(median(z), 6) as z, round(median(x), 6) as x, round(median(y), 6) as y from traces group by copy, label")
def homolog_centroids(s, d):
    return aggregates.centroids(A.traces(s, d), ["copy", "label"]).select("copy", "label", *[r(c).alias(c) for c in joins.AXES])


@query(f"""with {A.TRACES}, p as (select * from traces where x is not null)
select a.event_id, b.label, round(sum(exp(-(({D}) ** 2) / (2 * 30.0 * 30.0))), 6) as density from p a join p b on a.copy = b.copy and a.event_id <> b.event_id group by 1, 2""")
def compartment_densities(s, d):
    return aggregates.densities(A.traces(s, d), ["copy"], "event_id", "label", 30.0).select("event_id", "label", r("density").alias("density"))


@query(f"""with {A.TRACES}, p as (select * from traces where x is not null),
w as (select a.copy, a.event_id, coalesce(sum(exp(-(({D}) ** 2) / (2 * 30.0 * 30.0))) filter (where b.label = 'A'), 0) as da, coalesce(sum(exp(-(({D}) ** 2) / (2 * 30.0 * 30.0))) filter (where b.label = 'B'), 0) as db
  from p a join p b on a.copy = b.copy and a.event_id <> b.event_id group by 1, 2)
select copy, round(sum(sqrt(da * db)) / sqrt(sum(da) * sum(db)), 6) as overlap from w group by copy""")
def density_overlap(s, d):
    t = A.traces(s, d)
    dens = aggregates.densities(t, ["copy"], "event_id", "label", 30.0)
    wide = dens.groupBy("event_id").agg(*[F.coalesce(F.sum(F.when(F.col("label") == x, F.col("density"))), F.lit(0.0)).alias(f"d{x.lower()}") for x in "AB"])
    return aggregates.density_overlap(wide.join(t.select("event_id", "copy"), "event_id"), ["copy"], "da", "db").select("copy", r("overlap").alias("overlap"))


@query(f"""with {A.SPOTS}, q as (select cell_id, quantile_cont(height, 0.05) as lo, quantile_cont(height, 0.95) as hi from spots group by cell_id)
select uid, round((least(greatest(height, lo), hi) - lo) / nullif(hi - lo, 0), 6) as scaled from spots join q using (cell_id)""")
def winsorized_heights(s, d):
    return aggregates.winsorized(A.spots(s, d), ["cell_id"], "height", 0.05, 0.95).select("uid", r("scaled").alias("scaled"))


@query(f"""with {A.PAIRS} select copy, round(regr_slope(ln(d), ln(j - i)), 6) as slope, round(regr_intercept(ln(d), ln(j - i)), 6) as intercept, round(corr(ln(d), ln(j - i)), 6) as r
from pairs where d > 0 group by copy""")
def genomic_scaling(s, d):
    p = aggregates.pair_distances(A.traces(s, d), ["copy"], "region").withColumn("g", F.col("j") - F.col("i"))
    return aggregates.genomic_scaling(p, ["copy"], "g", "d").select("copy", r("slope").alias("slope"), r("intercept").alias("intercept"), r("r").alias("r"))


@query(f"""with {A.PAIRS} select i // 10 as da, j // 10 as db, round(avg(case when d <= 50 then 1.0 else 0.0 end), 6) as contact, count(*) as n from pairs group by 1, 2""")
def domain_contacts(s, d):
    t = A.traces(s, d)
    doms = t.selectExpr("copy", "region div 10 as domain").distinct().selectExpr("copy", "cast(domain as bigint) as domain", "cast(domain * 10 as int) as start", "cast(domain * 10 + 10 as int) as end")
    return aggregates.domain_contacts(aggregates.pair_distances(t, ["copy"], "region"), doms, ["copy"], 50.0).select(F.col("da").cast("int").alias("da"), F.col("db").cast("int").alias("db"), r("contact").alias("contact"), "n")


@query(f"""with {A.PAIRS}, p as (select copy, i // 8 = j // 8 as own, d from pairs where d is not null and j // 8 - i // 8 <= 1), c as (select copy, own, median(d) as m from p group by 1, 2),
v as (select copy, own, any_value(m) as m, median((d - m) ** 2) as v from p join c using (copy, own) group by 1, 2)
select copy, round(greatest(0, (max(m) filter (where not own) - max(m) filter (where own)) / sqrt((max(v) filter (where not own) + max(v) filter (where own)) / 2)), 5) as effect from v group by copy""")
def domain_effect_size(s, d):
    p = aggregates.pair_distances(A.traces(s, d), ["copy"], "region").where("j div 8 - i div 8 <= 1")
    return aggregates.effect_size(p, ["copy"], F.expr("i div 8 = j div 8")).select("copy", r("effect", 5).alias("effect"))


@query(f"with {A.SPOTS} select c.cell_id, " + ", ".join(f"coalesce(sum((bit = {b})::int), 0)::bigint as \"{b}\"" for b in range(12)) + " from (select distinct cell_id from spots) c left join spots using (cell_id) group by 1")
def cell_bit_counts(s, d):
    sp = A.spots(s, d)
    return aggregates.counts_wide(sp, ["cell_id"], "bit", list(range(12)), sp)


@query("""with calls as (select o_custkey as cell_id, l_returnflag || l_linestatus as gene from orders join lineitem on l_orderkey = o_orderkey)
select c_custkey as cell_id, """ + ", ".join(f"coalesce(sum((gene = '{g}')::int), 0)::bigint as \"{g}\"" for g in ("AF", "AO", "NF", "NO", "RF", "RO")) + " from customer left join calls on cell_id = c_custkey group by 1")
def gene_counts(s, d):
    o, li = A.table(s, d, "orders"), A.table(s, d, "lineitem")
    calls = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("cell_id"), F.concat("l_returnflag", "l_linestatus").alias("gene"))
    return aggregates.counts_wide(calls, ["cell_id"], "gene", ["AF", "AO", "NF", "NO", "RF", "RO"], A.cells(s, d))


# ---- joins ----


@query(f"with {A.SPOTS} select a.uid as a, b.uid as b, round({D}, 6) as distance from spots a join spots b on a.cell_id = b.cell_id and a.uid < b.uid and {D} <= 60")
def radius_pairs(s, d):
    return joins.radius_pairs(A.spots(s, d), 60.0, ["cell_id"], "uid").select(F.col("l.uid").alias("a"), F.col("r.uid").alias("b"), r("distance").alias("distance"))


@query(f"""with {A.SPOTS}, p as (select a.uid, {D} as d, b.uid as o from spots a join spots b on a.cell_id = b.cell_id),
n as (select uid, d, row_number() over (partition by uid order by d, o) as k from p) select uid, round(case when count(*) = 10 then avg(d) end, 6) as mean_distance from n where k <= 10 group by uid""")
def ten_neighbours(s, d):
    return joins.mean_neighbours(A.spots(s, d), 10, ["cell_id"], "uid", 150.0).select("uid", r("mean_distance").alias("mean_distance"))


@query(f"""with {A.SPOTS}, t as (select * from spots where bit < 6), q as (select * from spots where bit >= 6),
p as (select a.uid, b.uid as o, {D} as d from t a join q b on a.cell_id = b.cell_id)
select uid, arg_min(o, (d, o)) as nearest, round(min(d), 6) as distance from p group by uid""")
def nearest_spot(s, d):
    sp = A.spots(s, d)
    return joins.nearest(sp.where("bit < 6"), sp.where("bit >= 6"), ["cell_id"], "uid", "uid", 100.0).select("uid", "nearest", r("distance").alias("distance"))


@query(f"""with {A.SPOTS}, p as (select a.uid as a, b.uid as b, {D} as d, b.z - a.z as sz from spots a join spots b on a.cell_id = b.cell_id and a.bit < 6 and b.bit >= 6 and {D} <= 90),
c as (select *, count(*) over (partition by a) as na, count(*) over (partition by b) as nb from p) select a, b, round(d, 6) as distance, round(sz, 6) as shift_z from c where na = 1 and nb = 1""")
def mutual_partners(s, d):
    sp = A.spots(s, d)
    return joins.mutual_unique(sp.where("bit < 6"), sp.where("bit >= 6"), 90.0, ["cell_id"], "uid", "uid").select("a", "b", r("distance").alias("distance"), r("shift_z").alias("shift_z"))


@query(f"""with {A.SPOTS}, n as (select a.cell_id, a.uid as c, b.uid as m, b.region from spots a join spots b on a.cell_id = b.cell_id and {D} <= 90),
g as (select distinct cell_id, ms from (select cell_id, c, list(m order by m) as ms, count(distinct region) as k from n group by 1, 2) where k >= 2),
e as (select cell_id, ms, unnest(ms) as a from g), x as (select e.cell_id, e.ms, count(*) as k from e join n on n.cell_id = e.cell_id and n.c = e.a and list_contains(e.ms, n.m) group by 1, 2)
select cell_id, array_to_string(ms, ',') as members from x where k = len(ms) * len(ms)""")
def interaction_groups(s, d):
    return joins.interaction_groups(A.spots(s, d), 90.0, ["cell_id"], "uid", "region", 2).select("cell_id", F.concat_ws(",", "members").alias("members"))


@query(f"""with {A.PEAKS}, {A.REGIONS} select g.id, count(*) as n, round(sum(fold), 4) as fold from peaks p join regions g on p.chr = g.chr and midpoint >= g.start and midpoint < g."end" group by 1""")
def peaks_in_regions(s, d):
    return joins.interval_join(A.peaks(s, d), A.regions(s, d), "midpoint", closed=False).groupBy("g.id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("p.fold"), 4).alias("fold"))


@query(f"""with {A.PEAKS}, {A.REGIONS} select p.id, min(g.id) as first_region, max(g.id) as last_region from peaks p join regions g on p.chr = g.chr and midpoint between g.start and g."end" group by 1""")
def region_of_peak(s, d):
    j = joins.interval_join(A.peaks(s, d), A.regions(s, d), "midpoint", closed=True)
    return j.groupBy("p.id").agg(F.min("g.id").alias("first_region"), F.max("g.id").alias("last_region"))


@query(f"""with {A.PEAKS}, {A.REGIONS} select g.id, count(*) as n, sum(least(p."end", g."end") - greatest(p.start, g.start))::bigint as bases from peaks p join regions g on p.chr = g.chr and p.start < g."end" and g.start < p."end" group by 1""")
def overlaps(s, d):
    return joins.overlap_join(A.peaks(s, d), A.regions(s, d)).groupBy("r.id").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap").cast("long").alias("bases"))


# ---- windows ----


@query(f"""with {A.SPOTS} select uid, round(cume_dist() over w, 9) as weak, round((rank() over w - 1) / count(*) over (partition by cell_id), 9) as strict,
round(1 - cume_dist() over w + 0.5 / count(*) over (partition by cell_id), 9) as a_less, round((cume_dist() over w * count(*) over (partition by cell_id) + 1) / (count(*) over (partition by cell_id) + 2), 9) as b_greater
from spots window w as (partition by cell_id order by height)""")
def ecdf_scores(s, d):
    modes = {"weak": ("weak", True), "strict": ("strict", True), "a_less": ("a", False), "b_greater": ("b", True)}
    return windows.ecdfs(A.spots(s, d), "height", ["cell_id"], modes).select("uid", *[r(c, 9).alias(c) for c in modes])


@query(f"""with {A.SPOTS} select a.uid, round(sum((b.height <= a.height)::int) / count(*), 9) as score from spots a join spots b on a.channel = b.channel and b.bit < 6 where a.bit >= 6 group by 1""")
def foreign_ecdf(s, d):
    sp = A.spots(s, d)
    return windows.foreign_ecdf(sp.where("bit >= 6"), sp.where("bit < 6"), "height", ["channel"]).select("uid", r("score", 9).alias("score"))


@query(f"with {A.TRACES} select a.event_id, round({D}, 6) as distance from traces a left join traces b on a.copy = b.copy and b.region = a.region + 1")
def neighbour_distance(s, d):
    return windows.neighbour_distance(A.traces(s, d), ["copy"], "region").select("event_id", r("distance").alias("distance"))


@query(f"""with {A.TRACES}, m as (select a.event_id, avg(b.z) as z, avg(b.x) as x, avg(b.y) as y from traces a join traces b on a.copy = b.copy and b.region between a.region - 5 and a.region + 5 and b.region <> a.region group by 1)
select a.event_id, round({D}, 5) as distance from traces a left join m b using (event_id)""")
def local_distance(s, d):
    return windows.local_distance(A.traces(s, d), ["copy"], "region", 5).select("event_id", r("distance", 5).alias("distance"))


@query(f"""with {A.TRACES}, s as (select a.copy, a.region, {D} as d from traces a join traces b on a.copy = b.copy and b.region = a.region + 1)
select t.event_id, coalesce(n.d >= 70 and p.d >= 70, false) as loop_out from traces t left join s n on n.copy = t.copy and n.region = t.region left join s p on p.copy = t.copy and p.region = t.region - 1""")
def loop_outs(s, d):
    return windows.loop_outs(A.traces(s, d), ["copy"], "region", 70.0).select("event_id", "loop_out")


@query(f"""with {A.TRACES}, c as (select *, case when lag(label) over w = label then 0 else 1 end as c from traces window w as (partition by copy order by region)),
g as (select *, sum(c) over (partition by copy order by region) as run from c) select copy, min(region) as start, max(region) as "end", any_value(label) as label, count(*) as length from g group by copy, run""")
def label_runs(s, d):
    return windows.runs(A.traces(s, d), ["copy"], "region", "label").select("copy", "start", "end", "label", "length")


@query(f"""with {A.TRACES}, k as (select copy, region, z from traces where z is not null),
b as (select t.copy, t.region, t.z, max(k.region) filter (where k.region <= t.region) as lo, min(k.region) filter (where k.region >= t.region) as hi from traces t left join k on k.copy = t.copy group by 1, 2, 3)
select b.copy, b.region, round(case when lo is null then h.z when hi is null then l.z when lo = hi then l.z else l.z + (h.z - l.z) * (b.region - lo) / (hi - lo) end, 6) as filled
from b left join k l on l.copy = b.copy and l.region = lo left join k h on h.copy = b.copy and h.region = hi""")
def interpolated(s, d):
    return windows.interpolated(A.traces(s, d), ["copy"], "region", "z").select("copy", "region", r("filled").alias("filled"))


@query(f"""with {A.TRACES}, w as (select event_id, {', '.join(f'avg({c}) over l - avg({c}) over r as d{c}' for c in 'zxy')} from traces
window l as (partition by copy order by region rows between 4 preceding and 1 preceding), r as (partition by copy order by region rows between current row and 3 following))
select event_id, round(sqrt(dz ** 2 + dx ** 2 + dy ** 2), 5) as distance from w""")
def two_sided_distance(s, d):
    return windows.two_sided(A.traces(s, d), ["copy"], "region", 4).select("event_id", r("distance", 5).alias("distance"))


@query(f"""with {A.REGIONS} select id, chr, (row_number() over (partition by chr order by (start + "end") / 2, id) - 1)::int as chr_order, coalesce(lead(start) over (partition by chr order by start), 100000000)::bigint as domain_end from regions""")
def region_order(s, d):
    g = A.regions(s, d).withColumn("size", F.lit(100000000))
    g = windows.domain_ends(g.withColumnRenamed("end", "stop"), ["chr"], "start", "size")
    return g.selectExpr("id", "chr", "cast(row_number() over (partition by chr order by (start + stop) / 2, id) - 1 as int) as chr_order", "cast(end as bigint) as domain_end")


# ---- decoding and picking ----


@query(f"with {A.CODES_SQL}, {A.VALID_SQL} select * from valid")
def valid_bit_pairs(s, d):
    return decode.valid_pairs(A.codes(s))


@query(f"with {A.CODES_SQL}, {A.VALID_SQL}, b as (select distinct bit from codes) select a.bit as bit_a, c.bit as bit_b from b a join b c on a.bit < c.bit where (a.bit, c.bit) not in (select (bit_a, bit_b) from valid)")
def invalid_bit_pairs(s, d):
    return decode.invalid_pairs(A.codes(s))


CANDIDATES = f"""{A.SPOTS}, {A.CODES_SQL}, {A.VALID_SQL}, cand as (select a.cell_id, region_id, a.uid as a, b.uid as b, {D} as distance, (a.height + b.height) / 2 as height,
  abs(a.height - b.height) / (a.height + b.height) as variation, least(a.bit, b.bit) as bit_a, greatest(a.bit, b.bit) as bit_b, (a.z + b.z) / 2 as z, (a.x + b.x) / 2 as x, (a.y + b.y) / 2 as y
  from spots a join spots b on a.cell_id = b.cell_id and a.uid < b.uid and {D} <= 150 join valid on bit_a = least(a.bit, b.bit) and bit_b = greatest(a.bit, b.bit))"""


def _candidates(s, d):
    return decode.candidate_pairs(A.spots(s, d), A.codes(s), 150.0, ["cell_id"])


@query(f"with {CANDIDATES} select a, b, region_id, round(distance, 6) as distance, round(height, 6) as height, round(variation, 6) as variation from cand")
def candidate_pairs(s, d):
    return _candidates(s, d).select("a", "b", "region_id", *[r(c).alias(c) for c in ("distance", "height", "variation")])


@query(f"""with {CANDIDATES} select a, b, round(ln(cume_dist() over (partition by cell_id order by height)) + ln(cume_dist() over (partition by cell_id order by variation desc))
 + ln(cume_dist() over (partition by cell_id order by distance desc)), 6) as score from cand""")
def candidate_scores(s, d):
    return decode.scored(_candidates(s, d), ["cell_id"], ["height"], ["variation", "distance"]).select("a", "b", r("score").alias("score"))


@query(f"""with {CANDIDATES}, o as (select p.a, p.b, p.region_id, c.bit as need, p.cell_id, p.z, p.x, p.y from cand p join codes c using (region_id) where c.bit <> bit_a and c.bit <> bit_b)
select a.a, a.b, a.region_id, b.uid as c, round({D}, 6) as to_centre from o a join spots b on a.cell_id = b.cell_id and a.need = b.bit and {D} <= 150""")
def third_spots(s, d):
    sp = A.spots(s, d)
    return decode.third_spots(_candidates(s, d), sp, A.codes(s), 150.0, ["cell_id"]).select("a", "b", "region_id", "c", r("to_centre").alias("to_centre"))


@query()
def greedy_decoding(s, d):
    groups = decode.scored(_candidates(s, d), ["cell_id"], ["height"], ["variation", "distance"])
    return decode.greedy(groups.select("cell_id", "region_id", "a", "b", "score"), ["cell_id"]).select("cell_id", "region_id", "a", "b", r(r("score", 9)).alias("score"))


@query(f"with {CANDIDATES} select uid from spots where uid not in (select a from cand union select b from cand)")
def unused_spots(s, d):
    return decode.unused(A.spots(s, d), _candidates(s, d)).select("uid")


@query(f"with {A.SPOTS} select uid from spots s where not exists (select 1 from spots b, (select s.z, s.x, s.y) a where b.cell_id = s.cell_id and b.uid <> s.uid and (b.height > s.height or (b.height = s.height and b.uid < s.uid)) and {D} <= 80)")
def suppressed_duplicates(s, d):
    return decode.suppressed(A.spots(s, d), 80.0, ["cell_id"]).select("uid")


@query(f"with {A.SPOTS} select cell_id, region, arg_max(uid, (height, -uid)) as uid, round(max(height), 6) as height from spots group by 1, 2")
def naive_pick(s, d):
    return picking.brightest(A.spots(s, d), ["cell_id", "region"]).select("cell_id", "region", "uid", r("height").alias("height"))


@query(f"""with {A.SPOTS}, c as (select cell_id, region, uid, height / 1000 as s0, -abs(z) / 100 as s1 from spots),
p as (select a.cell_id, a.region, a.uid as x, b.uid as y, a.s0 + b.s1 as t, row_number() over (partition by a.cell_id, a.region order by a.s0 + b.s1 desc, a.uid, b.uid) as k from c a join c b on a.cell_id = b.cell_id and a.region = b.region and a.uid <> b.uid)
select cell_id, region, x as copy0, y as copy1, round(t, 6) as total from p where k = 1
union all select cell_id, region, case when s0 >= s1 then uid end, case when s0 < s1 then uid end, round(greatest(s0, s1), 6) from c where (cell_id, region) in (select (cell_id, region) from c group by all having count(*) = 1)""")
def two_copy_assignment(s, d):
    out = picking.pair_assignment(A.spots(s, d), ["cell_id", "region"], "uid", F.col("height") / 1000, -F.abs("z") / 100)
    return out.withColumn("total", r("total"))


@query()
def dynamic_pick(s, d):
    c = A.spots(s, d).withColumn("score", F.log(F.col("height") / 1000))
    return picking.dynamic_pick(c, ["cell_id"], "region", ref=100.0).select("cell_id", "region", "uid")


@query()
def iterative_pick(s, d):
    return picking.iterative_pick(A.spots(s, d).withColumn("chr", F.concat(F.lit("chr"), F.col("uid") % 2)), ["cell_id"]).withColumn("score", r("score"))


# ---- domains ----


@query()
def sliding_window_domains(s, d):
    return domains.called(A.traces(s, d), ["copy"])


@query()
def boundary_share(s, d):
    return domains.boundary_share(domains.called(A.traces(s, d), ["copy"]), ["copy"]).withColumn("share", r("share"))


@query()
def domain_interactions(s, d):
    return domains.interactions(A.traces(s, d), ["copy"])


# ---- scalar transforms and filters ----


@query(f"""with {A.SPOTS} select uid, round(250 * z, 6) as z, round(2048 - y, 6) as x, round(x, 6) as y from spots""")
def microscope_positions(s, d):
    out = geometry.microscope(A.spots(s, d), (2048, 2048), True, True, False)
    px = {"z": 250.0, "x": 1.0, "y": 1.0}
    return geometry.positions(out.withColumns({f"pixel_{c}": F.lit(v) for c, v in px.items()})).select("uid", *[r(c).alias(c) for c in joins.AXES])


@query(f"""with {A.SPOTS} select uid, round(z - 1.5, 5) as z, round(cos(radians(30)) * (x - 10) - sin(radians(30)) * (y - 20) + 10 - 2, 5) as x, round(sin(radians(30)) * (x - 10) + cos(radians(30)) * (y - 20) + 20 + 3, 5) as y from spots""")
def rotated_and_shifted(s, d):
    return geometry.moved(A.spots(s, d), 30.0, (10.0, 20.0), (1.5, 2.0, -3.0)).select("uid", *[r(c, 5).alias(c) for c in joins.AXES])


@query(f"with {A.SPOTS} select uid, round(z - (0.5 + 0.001 * z - 0.002 * x + 0.0001 * z * y), 5) as z, round(x - 0.003 * y * y / 100, 5) as x from spots")
def chromatic_correction(s, d):
    zero = [0.0] * 10
    z, x = list(zero), list(zero)
    z[0], z[1], z[2], z[6], x[9] = 0.5, 0.001, -0.002, 0.0001, 0.00003
    return geometry.chromatic(A.spots(s, d), {"z": z, "x": x, "y": zero}, 2, (0.0, 0.0, 0.0)).select("uid", r("z", 5).alias("z"), r("x", 5).alias("x"))


@query(f"""with {A.TRACES} select event_id, {', '.join(f'round(({c} - avg({c}) over w) / sqrt(var_pop(z) over w + var_pop(x) over w + var_pop(y) over w), 5) as {c}' for c in 'zxy')} from traces window w as (partition by copy)""")
def centred_traces(s, d):
    return geometry.centred(A.traces(s, d), ["copy"], True).select("event_id", *[r(c, 5).alias(c) for c in joins.AXES])


@query(f"with {A.SPOTS} select uid, round(height / avg(height) over (partition by channel), 6) as height from spots")
def normalised_heights(s, d):
    return geometry.normalised(A.spots(s, d), "height", ["channel"]).select("uid", r("height").alias("height"))


@query(f"with {A.SPOTS} select uid, round(ln(abs(z) / 2000 + 1), 6) as log_score, round(-exp(abs(z) / 2000), 6) as exp_score, round(-abs(z) / 100 + ln(height / (height + 1200)), 6) as linear from spots where height between 1100 and 1300 and background between 100 and 120")
def filtered_scores(s, d):
    sp = A.spots(s, d).where(F.col("height").between(1100, 1300) & F.col("background").between(100, 120))
    z = F.abs("z")
    return sp.select("uid", r(geometry.log_distance_score(z)).alias("log_score"), r(geometry.exp_distance_score(z)).alias("exp_score"), r(geometry.linear_scores(z, F.col("height"), 100.0, 1200.0)).alias("linear"))


# ---- probe design ----

_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"


@query(f"with {A.sequences_sql('documents', 'doc_id')}, {A.words_sql(8)} select word, least(count(*), 65535)::bigint as n from words group by word")
def word_counts(s, d):
    return library.word_table(A.sequences(s, d, "documents", "doc_id"), 8)


@query(f"""with {A.sequences_sql('documents', 'doc_id', 'genome')}, {A.words_sql(10, 'genome', 'gw')}, t as (select word, least(count(*), 65535) as n from gw group by word), {A.sequences_sql()}, {A.words_sql(10)},
f as (select uid, sum(coalesce(n, 0))::bigint as hits from words left join t using (word) group by uid), rc as (select uid, {_RC} as seq from sequences), {A.words_sql(10, 'rc', 'rw')},
g as (select uid, sum(coalesce(n, 0))::bigint as reverse_hits from rw left join t using (word) group by uid) select uid, hits, reverse_hits from f join g using (uid)""")
def probe_hits(s, d):
    t, p = library.word_table(A.sequences(s, d, "documents", "doc_id"), 10), A.sequences(s, d)
    return library.both_hits(p, t, 10, "uid")


@query(f"""with {A.sequences_sql()}, c as (select uid, s - 1 as start, substr(seq, s, 30) as seq from (select uid, seq, unnest(range(1, length(seq) - 28)) as s from sequences where length(seq) >= 30))
select uid, start::int as start, round((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / 30.0, 6) as gc, {_RC} as rc from c where (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / 30.0 between 0.4 and 0.6""")
def gated_probes(s, d):
    return library.gated(library.candidates(A.sequences(s, d), 30, "uid"), (0.4, 0.6), (-1000.0, 1000.0)).select("uid", "start", r("gc").alias("gc"), dna.reverse_complement(F.col("seq")).alias("rc"))


@query()
def placed_probes(s, d):
    c = library.gated(library.candidates(A.sequences(s, d), 30, "uid"), (0.4, 0.6), (40.0, 90.0)).withColumn("score", -F.abs(F.col("gc") - 0.5))
    return library.placed(c, "uid", 30, 2).select("uid", "start", r("gc").alias("gc"), r("tm").alias("tm"))


@query(f"""with {A.sequences_sql()}, {A.words_sql(12)}, f as (select distinct uid as a, word from words), rc as (select uid, {_RC} as seq from sequences), {A.words_sql(12, 'rc', 'rw')},
b as (select uid as b, word from words union select uid, word from rw) select a, b, count(*) as shared from f join b using (word) where a > b group by 1, 2""")
def similar_sequences(s, d):
    return library.shared_words(A.sequences(s, d), 12, "uid")


@query(f"""with {A.sequences_sql()} select uid, substr(seq, 1, 20) as primer5, substr(seq, 41, length(seq) - 100) as target, substr(seq, length(seq) - 19, 20) as primer3, seq as whole,
(select sum((position(substr(seq, k, 1) in 'ACGT') - 1) * 4 ** (15 - k)) from range(1, 16) t(k))::bigint as packed from sequences where length(seq) >= 101""")
def probe_round_trip(s, d):
    p = dna.parsed(F.col("seq"))
    out = A.sequences(s, d).where(F.length("seq") >= 101).select("uid", "seq", p.alias("p"))
    five, three = F.get("p.readouts5", F.lit(0)), [F.get("p.readouts3", F.lit(k)) for k in (0, 1)]
    whole = dna.assembled(F.col("p.primer5"), [five], F.col("p.target"), three, F.col("p.primer3"))
    return out.select("uid", "p.primer5", "p.target", "p.primer3", whole.alias("whole"), dna.pack(F.substring("seq", 1, 15)).alias("packed"))


# ---- merging ----

VOXELS = "voxels as (select c_nationkey as fov_id, (c_custkey % 13)::int as z, (c_custkey % 29)::int as x, (c_custkey % 31)::int as y, (c_custkey % 7)::int as label from customer)"


def _voxels(s, d):
    return A.table(s, d, "customer").selectExpr("c_nationkey as fov_id", "cast(c_custkey % 13 as int) as z", "cast(c_custkey % 29 as int) as x", "cast(c_custkey % 31 as int) as y", "cast(c_custkey % 7 as int) as label")


@query(f"""with {A.SPOTS}, rep as (select * from spots where bit >= 6) select uid from spots where (cell_id, region) not in (select (cell_id, region) from rep) union all select uid from rep""")
def recombined_spots(s, d):
    sp = A.spots(s, d)
    return merging.recombined(sp, sp.where("bit >= 6"), ["cell_id", "region"]).select("uid")


@query(f"""with {A.SPOTS}, refs as (select cell_id, region, arg_max(z, (height, -uid)) as z, arg_max(x, (height, -uid)) as x, arg_max(y, (height, -uid)) as y from spots where bit < 3 group by 1, 2)
select a.uid from spots a left join refs b on a.cell_id = b.cell_id and a.region = b.region where b.z is null or {D} <= 150""")
def spots_near_reference(s, d):
    sp = A.spots(s, d)
    return merging.near_reference(sp, picking.brightest(sp.where("bit < 3"), ["cell_id", "region"]), ["cell_id", "region"], 150.0).select("uid")


@query(f"""with {VOXELS}, pt as (select event_id as uid, (event_id % 11)::int as z, (event_id % 27)::int as x, (event_id % 23)::int as y from events),
f as (select uid, label, count(*) as n from pt a join voxels b on abs(a.z - b.z) <= 1 and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 where label <> 0 group by 1, 2),
g as (select uid, arg_max(label, (n, -label)) as label from f group by 1) select uid, coalesce(label, -1)::int as label from pt left join g using (uid)""")
def spot_labels(s, d):
    pt = A.table(s, d, "events").selectExpr("event_id as uid", "cast(event_id % 11 as double) as z", "cast(event_id % 27 as double) as x", "cast(event_id % 23 as double) as y")
    return merging.labels_of(pt, _voxels(s, d), "uid")


@query(f"""with {VOXELS} select fov_id, label, count(*) as volume, {', '.join(f'round((avg({c}) - {m}::double) * {p}::double, 6) as center_{c}, round((min({c}) - {m}::double) * {p}::double, 6) as min_{c}, round((max({c}) + 1 - {m}::double) * {p}::double, 6) as max_{c}' for c, m, p in (('z', 6.5, 0.2), ('x', 14.5, 0.108), ('y', 15.5, 0.108)))}
from voxels where label > 0 group by 1, 2""")
def cell_locations(s, d):
    out = merging.cell_locations(_voxels(s, d), "fov_id", (6.5, 14.5, 15.5), (0.2, 0.108, 0.108))
    return out.select("fov_id", "label", "volume", *[r(c).alias(c) for c in out.columns[3:]])


@query(f"with {A.TRACES} select chr, label, round(count(*) / sum(count(*)) over (partition by chr), 9) as share from traces group by 1, 2")
def confusion_shares(s, d):
    return merging.confusion(A.traces(s, d), "chr", "label").select("chr", "label", r("share", 9).alias("share"))


@query(f"""with {A.SPOTS}, m as (select channel, bit, median(height) as m from spots group by 1, 2), low as (select channel, bit from (select *, row_number() over (partition by channel order by m, bit) as k from m) where k <= 2),
b as (select channel, avg(height) as mean, stddev_pop(height) as std from spots join low using (channel, bit) group by 1)
select uid, case when (height - mean) / std > 4.753424 then 1 when (height - mean) / std <= 2.326348 then -1 else 0 end::int as flag from spots join b using (channel)""")
def intensity_flags(s, d):
    return merging.intensity_flags(A.spots(s, d), "channel", "bit", "height", 2).select("uid", "flag")


@query(f"""with {A.SPOTS}, p as (select cell_id, z / 50 as z, x / 50 as x, y / 50 as y from spots), o as (select unnest(range(-1, 2)) as o),
g as (select cell_id, (round(z) + a.o)::int as gz, (round(x) + b.o)::int as gx, (round(y) + c.o)::int as gy, p.z, p.x, p.y from p, o a, o b, o c)
select cell_id, gz as z, gx as x, gy as y, round(sum(exp(-((gz - z) ** 2 + (gx - x) ** 2 + (gy - y) ** 2) / (2 * 0.8 * 0.8))), 6) as density from g group by 1, 2, 3, 4""")
def spot_clouds(s, d):
    p = A.spots(s, d).select("cell_id", *[(F.col(c) / 50).alias(c) for c in joins.AXES])
    return merging.cloud(p, ["cell_id"], 0.8, 1).withColumn("density", r("density"))


@query()
def bootstrap_interval(s, d):
    return merging.bootstrap(A.spots(s, d), ["cell_id"], "height", "uid").select("cell_id", r("low").alias("low"), r("high").alias("high"))


@query(f"""with {A.TRACES}, p as (select a.chr as chr_a, b.chr as chr_b, a.label as kind_a, b.label as kind_b, {D} as d from traces a join traces b on a.copy = b.copy and a.event_id < b.event_id)
select least(chr_a, chr_b) as chr_a, greatest(chr_a, chr_b) as chr_b, case when chr_a = chr_b then 'cis' else 'trans' end as kind, round(median(d), 6) as median, count(d) as n from p group by 1, 2, 3""")
def cis_trans_map(s, d):
    t = A.traces(s, d).select("copy", F.struct("event_id", "chr", *joins.AXES).alias("p"))
    pairs = t.withColumnRenamed("p", "l").join(t.withColumnRenamed("p", "r"), "copy").where("l.event_id < r.event_id").withColumn("d", joins.distance("l", "r"))
    chrs = pairs.select(F.least("l.chr", "r.chr").alias("chr_a"), F.greatest("l.chr", "r.chr").alias("chr_b"), "d")
    kind = F.when(F.col("chr_a") == F.col("chr_b"), "cis").otherwise("trans").alias("kind")
    return statistics.medians(chrs, ["chr_a", "chr_b"], "d").select("chr_a", "chr_b", kind, r("median").alias("median"), "n")


from tracemill.plans import more  # noqa: E402, F401
