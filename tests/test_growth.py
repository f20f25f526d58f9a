"""Operators on large groups: right against brute force, without listing the pairs of a group."""

import tracemalloc
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
from oracle import TABLES, duck, same
from pyspark.sql import functions as F

from tracemill.functions import statistics
from tracemill.operators import aggregates, compartments, decode, domains, homologs, images, joins, library, merging, near, picking, registration, windows, words
from tracemill.plans import adapters, catalog

AXES = ["z", "x", "y"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, xyz, **more):
    """uid, place and columns of ints, doubles or texts."""
    kinds = {"i": "bigint", "f": "double", "U": "string"}
    columns = {k: np.asarray(v) for k, v in more.items()}
    rows = [(k, *map(float, p), *[c[k].item() for c in columns.values()]) for k, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "uid bigint, z double, x double, y double" + "".join(f", {n} {kinds[c.dtype.kind]}" for n, c in columns.items()))


def test_densities_of_other_copies_without_pairs(spark):  # F1
    rng = np.random.default_rng(3)
    n = 3000
    xyz = np.c_[rng.exponential(50, n), rng.integers(0, 97, n), rng.normal(0, 60, n)]
    copy, label = rng.integers(0, 40, n), np.array(["A", "B"])[rng.integers(0, 2, n)]
    copy[:400] = 99
    t = points(spark, xyz, cell=np.zeros(n, int), copy=copy, label=label)
    e = np.exp(-((xyz[:, None] - xyz[None]) ** 2).sum(2) / (2 * 30.0 * 30.0))
    for cis in (True, False):
        out = compartments.side_densities(t, ["cell"], "uid", "label", "copy", 30.0, cis=cis, trans=not cis)
        got = {(r.uid, r.label): r.density for r in out.collect()}
        met = (copy[:, None] == copy[None]) == cis
        np.fill_diagonal(met, False)
        want = {(i, x): e[i][met[i] & (label == x)].sum() for i in range(n) for x in "AB" if (met[i] & (label == x)).any()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) <= 1e-9 for k, v in want.items())
    assert "Join" not in plan(compartments.side_densities(t, ["cell"], "uid", "label", "copy", 30.0, cis=False))


def test_first_centres_hold_no_list_of_pairs():  # F2
    def plain(xyz, region):
        pairs, d = [(i, j) for i in range(len(xyz)) for j in range(i)], np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
        cover, radius = [], []
        for i, j in pairs:
            second = d[i] > d[j]
            cover.append(len({*region[second]} & {*region[~second]}))
            radius.append(round(d[i][~second].mean() + d[j][second].mean(), 6) if second.any() else -np.inf)
        share = lambda v: (np.array(v)[None] <= np.array(v)[:, None]).mean(1)
        return pairs[int(np.argmax(share([-x for x in radius]) * share(cover)))]

    for seed in range(60):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 30))
        xyz, region = rng.normal(0, 100, (n, 3)) if seed % 3 else rng.integers(0, 3, (n, 3)).astype(float), rng.integers(0, 1 + seed % 7, n)
        assert homologs.two_centres(xyz, region, block=60) == plain(xyz, region)
    rng = np.random.default_rng(1)
    tracemalloc.start()
    homologs.two_centres(rng.normal(0, 100, (500, 3)), rng.integers(0, 5, 500))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6


def test_neighbours_box_by_box():  # F5, F18
    for seed in range(30):
        rng = np.random.default_rng(seed)
        n, m, k = int(rng.integers(0, 400)), int(rng.integers(0, 400)), int(rng.integers(1, 12))
        draw = (lambda n: rng.normal(0, 100, (n, 3))) if seed % 2 else lambda n: rng.integers(0, 4, (n, 3)).astype(float)  # ties  # noqa: B023
        a, b = draw(n), draw(m)
        for own in (False, True):
            others = a if own else b
            d = near.apart(a, others)
            if own:
                np.fill_diagonal(d, np.inf)
            want = np.argsort(d, axis=1, kind="stable")[:, : max(0, min(k, len(others) - own))]
            index, distance = near.nearest(a, others, k, own)
            assert (index == want).all() and (distance == np.take_along_axis(d, want, 1)).all()


def test_neighbour_kernels_hold_no_square(spark):  # F5
    rng = np.random.default_rng(5)
    xyz = rng.normal(0, 126, (4000, 3))
    tracemalloc.start()
    near.nearest(xyz, xyz, 6, own=True)
    sum(1 for _ in near.cliques(xyz, 90.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4000 * 4000 * 8 / 4


def test_a_ball_of_many_points_is_looked_at_once():  # F3
    xyz = np.repeat([[0.0, 0, 0], [50, 0, 0], [200, 0, 0]], [300, 200, 1], axis=0)
    assert [b.tolist() for b in near.cliques(xyz, 60.0)] in ([[*range(500)], [500]], [[500], [*range(500)]])


def test_groups_by_their_points_and_not_by_pairs(spark):  # F3, F18, F19
    rng = np.random.default_rng(6)
    n = 300
    xyz, region = rng.normal(0, 60, (n, 3)), rng.integers(0, 4, n)
    p = points(spark, xyz, cell=np.arange(n) % 2, region=region)
    same = (np.arange(n)[:, None] - np.arange(n)) % 2 == 0
    d = np.where(same, near.apart(xyz, xyz), np.inf)
    groups = joins.interaction_groups(p, 30.0, ["cell"], "uid", "region", 2)
    balls = [np.flatnonzero(d[i] <= 30) for i in range(n)]
    want = {(int(b[0] % 2), tuple(b.tolist())) for b in balls if (d[np.ix_(b, b)] <= 30).all() and len({*region[b]}) >= 2}
    assert {(r.cell, tuple(r.members)) for r in groups.collect()} == want and want
    step = windows.step_distance(p, ["cell"], "region", "uid", 2)
    far = {i: d[i][same[i] & (region == region[i] + 2)] for i in range(n)}
    got = {r.uid: r.distance for r in step.collect()}
    assert len(got) == n and all((got[i] is None) if not len(v) else abs(got[i] - np.median(v)) < 1e-9 for i, v in far.items())
    mean = joins.mean_neighbours(p, 10, ["cell"], "uid", 20.0)
    assert all(abs(r.mean_distance - np.sort(d[r.uid])[:10].mean()) < 1e-9 for r in mean.collect())
    assert not any("Join" in plan(x) for x in (groups, step, mean, joins.nearest(p, p, ["cell"], "uid", "uid", 5.0)))


def test_completed_codes_meet_once(spark):  # F4, F6, F8
    rng = np.random.default_rng(7)
    n = 150
    xyz, bit = rng.normal(0, 60, (n, 3)), rng.integers(0, 12, n)
    p = points(spark, xyz, cell=np.arange(n) % 2, bit=bit, height=rng.uniform(1, 2, n))
    codes = adapters.codes(spark)
    valid = {}
    for region, bits in sorted(adapters.CODES.items()):
        for pair in combinations(sorted(bits), 2):
            valid.setdefault(pair, region)
    whole = lambda b: {valid.get((x, y)) for x, y in combinations(sorted(b), 2)}
    near_ = lambda s: all(np.linalg.norm(xyz[a] - xyz[b]) <= 100 for a, b in combinations(s, 2)) and all(np.linalg.norm((xyz[s[k - 1]] + xyz[s[k - 2]]) / 2 - xyz[s[k]]) <= 100 for k in range(3))
    want = {s for s in combinations(range(n), 3) if len({x % 2 for x in s}) == 1 and len({*bit[list(s)]}) == 3 and len(w := whole(bit[list(s)].tolist())) == 1 and None not in w and near_(s)}
    out = decode.completed(p, codes, 100.0, ["cell"], copied=("height",))
    rows = out.collect()
    assert len(rows) == len(want) and {(r.a, r.b, r.c) for r in rows} == want and all([m.uid for m in r.members] == [r.a, r.b, r.c] for r in rows)
    text = plan(out)
    assert text.index("Join") < text.index("Exchange")  # what is found is not shuffled again


def test_voxels_of_one_place_keep_their_own_values(spark):  # F10
    rows = [(0, 1, 1, 1, 1, 10.0), (0, 1, 1, 1, 0, 4.0), (0, 2, 1, 1, 1, 3.0), (0, 2, 1, 1, 0, 5.0), (0, 3, 1, 1, 2, 1.0)]
    v = spark.createDataFrame(rows, "fov_id int, z int, x int, y int, label int, value double")
    got = images.gated_masks(v, None, ["fov_id"], 1, 1.05).collect()
    assert sorted((r.z, r.label) for r in got) == [(1, 1), (2, 1)]  # 6.5 of label 1 against 4.5 of none


def test_masks_of_places_with_several_rows(spark, tmp_path):  # F10
    big = spark.range(60).selectExpr("id as c_custkey", "cast(0 as int) as c_nationkey", "id * 1.5 as c_acctbal")
    both = big.unionByName(big.withColumn("c_custkey", big.c_custkey + 13 * 29 * 31).withColumn("c_acctbal", big.c_acctbal * -2))
    for t in TABLES:
        (both if t == "customer" else spark.range(1)).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    same(catalog.QUERIES["gated_masks"](spark, str(tmp_path)), catalog.ORACLE["gated_masks"], con)


def test_best_pair_meets_only_who_can_win(spark):  # F11
    for seed in range(4):
        rng = np.random.default_rng(seed)
        n = 120
        s = rng.integers(0, 5, (n, 2)).astype(float) if seed % 2 else rng.normal(0, 1, (n, 2))
        c = points(spark, np.zeros((n, 3)), k=np.arange(n) % 3, s0=s[:, 0], s1=s[:, 1])
        got = {r.k: (r.copy0, r.copy1, r.total) for r in picking.pair_assignment(c, ["k"], "uid", F.col("s0"), F.col("s1")).collect()}
        for k in range(3):
            g = [i for i in range(n) if i % 3 == k]
            assert got[k] == min(((x, y, s[x, 0] + s[y, 1]) for x in g for y in g if x != y), key=lambda p: (-p[2], p[0], p[1]))
    one = points(spark, np.zeros((3000, 3)), k=np.zeros(3000, int), s0=np.random.default_rng(9).normal(0, 1, 3000), s1=np.zeros(3000))
    df = picking.pair_assignment(one, ["k"], "uid", F.col("s0"), F.col("s1"))
    assert df.count() == 1
    meets = [x for x in plan(df).split("\n") if "Join" in x and "u#" in x and "NOT" in x]
    assert meets and all("_least" not in x for x in meets) and "_least" in plan(df)


def test_labels_of_places_are_counted_before_spots_ask(spark):  # F15
    rng = np.random.default_rng(10)
    v, at = rng.integers(0, 5, (400, 4)), rng.integers(0, 6, (200, 3))
    voxels = spark.createDataFrame([tuple(map(int, x)) for x in v], "z int, x int, y int, label int")
    out = merging.labels_of(points(spark, at), voxels, "uid")
    for r in out.collect():
        n = np.bincount(v[(abs(v[:, :3] - at[r.uid]) <= 1).all(1) & (v[:, 3] > 0), 3], minlength=1)
        assert r.label == (int(n.argmax()) if n.any() else -1)
    assert not any("uid" in x for x in plan(out).split("\n") if "Generate explode" in x)  # voxels are spread, not spots


def test_medians_of_large_groups(spark):  # F24
    rng = np.random.default_rng(11)
    g, v = rng.integers(0, 4, 6001), rng.normal(0, 5, 6001)
    v[g == 2] = 3.25
    df = points(spark, np.zeros((6001, 3)), g=g, v=v).selectExpr("nullif(g, 1) as g", "case when uid % 7 > 0 and g <> 3 then v end as v")
    known = np.arange(6001) % 7 > 0
    for whole in (100_000, 50):  # 10 values about the middle of some 1,300
        got = {r.g: (r.median, r.n) for r in statistics.medians(df, ["g"], "v", whole).collect()}
        assert got == {(None if k == 1 else k): (float(np.median(v[known & (g == k)])), int((known & (g == k)).sum())) if k < 3 else (None, 0) for k in range(4)}


def test_flags_come_along_with_points(spark):  # F26
    t = adapters.traces(spark, "/root/testdata/sf0.001").withColumn("flag", F.lit(1))
    out = compartments.dependent_maps(aggregates.pair_distances(t, ["copy"], "region", ["flag"]), 50.0)
    assert plan(out).count("Join") == 1


def test_spots_of_a_chromosome_that_goes_find_another(spark):  # F29
    def plain(c, s, rounds, most):
        left = list(range(len(c)))
        while left:
            home = np.argmin(((s[:, None] - c[left][None]) ** 2).sum(2), axis=1)
            lost = [1 - len({*rounds[home == k]}) / len({*rounds}) for k in range(len(left))]
            if max(lost) <= most:
                break
            del left[int(np.argmax(lost))]
        return left

    rng = np.random.default_rng(12)
    c, s, rounds = rng.normal(0, 100, (40, 3)), rng.normal(0, 100, (150, 3)), rng.integers(0, 12, 150)
    got = registration.chromosomes(points(spark, c, cell=np.zeros(40, int)), points(spark, s, cell=np.zeros(150, int), height=np.ones(150), round=rounds), ["cell"], "uid").collect()
    assert sorted(r.uid for r in got) == plain(c, s, rounds, 0.4) != []


def test_copies_in_batches(spark):  # F12, F17, F20, F21, F25, F27
    t = adapters.traces(spark, "/root/testdata/sf0.001").where("copy < 6 or region < 2")
    t = t.unionByName(t.where("copy = 3").withColumn("copy", F.lit(None).cast("bigint"))).unionByName(t.where("copy = 2 and region = 0").withColumn("copy", F.lit(1000).cast("bigint")))
    doms = t.selectExpr("copy", "cast(region div 6 as int) as domain").distinct().selectExpr("copy", "domain", "domain * 6 as start", "domain * 6 + 6 as end")
    every = lambda: [sorted(map(str, f.collect())) for f in (domains.called(t, ["copy"]), domains.interactions(t, ["copy"]), domains.domain_stats(t, ["copy"]), domains.sliding_effects(t, ["copy"]), domains.loop_out_hits(t, doms, ["copy"]))]
    whole = every()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # less than a copy
    try:
        assert every() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for copy in (None, 0, 5, 1000):  # a copy by itself
        one = t.where(F.col("copy").eqNullSafe(F.lit(copy)))
        assert sorted(map(str, domains.called(one, ["copy"]).collect())) == [x for x in whole[0] if x.startswith(f"Row(copy={copy},")]
    assert all("Join" not in plan(f) and "FlatMapGroups" not in plan(f) for f in (domains.called(t, ["copy"]), domains.loop_out_hits(t, doms.localCheckpoint(), ["copy"])))


def test_lines_between_known_entries():  # F25
    rng = np.random.default_rng(13)
    for n in range(1, 40):
        m = np.where(rng.random((n, n)) < 0.4, np.nan, rng.normal(0, 1, (n, n)))
        want, x = m.copy(), np.arange(n)
        for row in want:
            known = ~np.isnan(row)
            if known.sum() >= 2:
                row[~known] = np.interp(x[~known], x[known], row[known])
        want = np.where(np.isnan(want), want.T, np.where(np.isnan(want.T), want, (want + want.T) / 2))
        assert np.array_equal(domains.filled(m), want, equal_nan=True)


ODD = ["ACGTACGTTTGACA", "", None, "ACG", "ACGNACGTTT", "acgtACGT", "ACGé日ACGT", "A" * 70, "TTTGACAACGTACGT" * 5]


def test_words_in_batches(spark, monkeypatch):  # F22, F30
    df = spark.createDataFrame([(k, s) for k, s in enumerate(ODD)], "uid int, seq string")
    for k in (1, 4, 7, 10, 12, 16, 31, 33):
        want = Counter(s[i : i + k] for s in ODD if s for i in range(len(s) - k + 1))
        assert {r.word: r.n for r in library.word_table(df, k).collect()} == want
    monkeypatch.setattr(words, "BLOCK", 5)
    for k in (1, 4, 7, 12, 33):
        want = Counter(s[i : i + k] for s in ODD if s for i in range(len(s) - k + 1))
        got = Counter()
        for found in words._rows(pa.array([None, *ODD, "CC"])[1:-1], k):
            got.update([found[1][i : i + k] for i in range(len(found[1]) - k + 1)] if len(found) == 2 else words.spelled(found[2], k).to_pylist())
            assert len(found) == 2 or all(ODD[r][i : i + k] == x for r, i, x in zip(found[0].tolist(), found[1].tolist(), words.spelled(found[2], k).to_pylist(), strict=True))
        assert got == want
    assert "Generate explode" not in plan(library.word_table(df, 8))


def test_parts_meet_only_where_they_may_begin(spark):  # F16
    df = spark.createDataFrame([(k, s) for k, s in enumerate(ODD)], "uid int, seq string")
    parts = ["ACGT", "TTTGACA", "ACGNAC", "gtAC", "é日AC", "GGGG", "AAAAAAAAAAA", "TTTGACAACGTACGTTTTG"]
    out = joins.containing(df, spark.createDataFrame([(100 + k, s) for k, s in enumerate(parts)], "uid int, seq string"), 4)
    assert sorted(map(tuple, out.collect())) == sorted((i, 100 + k) for i, s in enumerate(ODD) for k, x in enumerate(parts) if s and x in s)
    assert "Generate explode" not in plan(out)


def test_decoding_in_batches(spark):  # F9, F14, F23
    sf = "/root/testdata/sf0.01"
    for name in ("greedy_decoding", "triple_decoding"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # a cell goes on in the next batch
        try:
            same(catalog.QUERIES[name](spark, sf), catalog.ORACLE[name], duck(sf))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert "Groups" not in plan(catalog.QUERIES[name](spark, sf))  # no cell's pairs in one frame
    text = plan(catalog.QUERIES["candidate_scores"](spark, sf))
    assert "Exchange" not in text[: text.rindex("Window")]  # one shuffle for all shares


def test_third_spots_meet_by_bucket(spark):  # F7
    sp = adapters.spots(spark, "/root/testdata/sf0.01")
    pairs = decode.candidate_pairs(sp, adapters.codes(spark), 150.0, ["cell_id"])
    text = plan(decode.third_spots(pairs, sp, adapters.codes(spark), 150.0, ["cell_id"]))
    assert "_bz" in next(x for x in text.split("\n") if "Join" in x)
