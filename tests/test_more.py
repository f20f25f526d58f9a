"""Kernels, readers and writers on small cases: by hand, by brute force, or on synthetic images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import arrays, dna, registry
from tracemill.operators import celltypes, compartments, domains, fits, groups, homologs, images, joins, library, picking, registration
from tracemill.sources import images as image_files
from tracemill.sources import tables, text


def one(spark, e):
    return spark.range(1).select(e.alias("x")).first().x


def cloud(spark, xyz, **more):
    names = list(more)
    rows = [(k, *map(float, p), 1, *[more[c][k] for c in names]) for k, p in enumerate(xyz)]
    kinds = {int: "int", float: "double", str: "string"}
    return spark.createDataFrame(rows, "uid int, z double, x double, y double, cell int" + "".join(f", {c} {kinds[type(more[c][0])]}" for c in names))


# ---- joins ----


def test_nearest_with_and_without_a_radius(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 100, (80, 3)), rng.uniform(0, 100, (60, 3))
    left, right = cloud(spark, a), cloud(spark, b)
    want = {k: int(np.linalg.norm(b - p, axis=1).argmin()) for k, p in enumerate(a)}
    k10 = {k: float(np.sort(np.linalg.norm(a - p, axis=1))[:10].mean()) for k, p in enumerate(a)}
    for radius in (None, 5.0, 30.0, 500.0):
        assert {r.uid: r.nearest for r in joins.nearest(left, right, ["cell"], "uid", "uid", radius).collect()} == want
        got = {r.uid: r.mean_distance for r in joins.mean_neighbours(left, 10, ["cell"], "uid", radius).collect()}
        assert all(math.isclose(got[k], v) for k, v in k10.items())
    assert joins.mean_neighbours(left.limit(4), 10, ["cell"], "uid", 5.0).where("mean_distance is not null").count() == 0


def test_densities_within_reach(spark):
    rng = np.random.default_rng(1)
    t = cloud(spark, rng.uniform(0, 200, (60, 3)), label=["AB"[k % 2] for k in range(60)])
    whole = {(r.uid, r.label): r.density for r in compartments.side_densities(t, ["cell"], "uid", "label", "uid", 10.0).collect()}
    near = {(r.uid, r.label): r.density for r in compartments.side_densities(t, ["cell"], "uid", "label", "uid", 10.0, reach=6.0).collect()}
    assert all(abs(near.get(k, 0.0) - v) <= 60 * math.exp(-18) for k, v in whole.items())


# ---- order-dependent selections ----


def test_sparse_replicates_and_unique_matches(spark):
    p = cloud(spark, [(0, 0, 0), (0, 3, 0), (0, 10, 0), (0, 12, 0), (0, 30, 0)], height=[1.0, 5.0, 3.0, 2.0, 0.5])
    assert sorted(r.uid for r in registration.sparse(p, ["cell"], ["uid"], 4.0).collect()) == [0, 2, 4]
    assert sorted(r.uid for r in registration.without_replicates(p, ["cell"], ["uid"], 4.0, 1.0).collect()) == [0, 2]
    a, b = cloud(spark, [(0, 0, 0), (0, 1, 0), (0, 50, 0)]), cloud(spark, [(0, 0.6, 0), (0, 3, 0)])
    assert sorted((r.a, r.b) for r in registration.aligned_once(a, b, ["cell"], 5.0).collect()) == [(0, 0), (1, 1)]


def test_translation_is_found(spark):
    rng = np.random.default_rng(2)
    fixed = rng.uniform(0, 300, (50, 3))
    moved = np.r_[fixed[:35] + [4.2, -7.5, 11.1] + rng.normal(0, 0.05, (35, 3)), rng.uniform(0, 300, (15, 3))]
    r = registration.translation(cloud(spark, moved), cloud(spark, fixed), ["cell"], 20.0, 1.0).first()
    assert r.votes >= 20 and np.allclose([r.shift_z, r.shift_x, r.shift_y], [4.2, -7.5, 11.1], atol=0.1)
    assert np.allclose(images.bead_shift(fixed, moved), [4.2, -7.5, 11.1], atol=0.1)


def test_chromosomes_without_spots_go(spark):
    c = cloud(spark, [(0, 0, 0), (0, 100, 0), (0, 200, 0)])
    near = [(0, 1, 0), (0, 99, 0)]
    s = cloud(spark, near * 4 + [(0, 200, 0)], height=[1.0] * 9, round=[k // 2 for k in range(8)] + [0])
    assert sorted(r.uid for r in registration.chromosomes(c, s, ["cell"], "uid").collect()) == [0, 1]


def test_outlying_pairs_go(spark):
    xyz = [(0, x, y) for x in range(5) for y in range(5)]
    slope = [0.1 + 0.001 * (k % 3) for k in range(25)]
    slope[12] = 3.0
    p = cloud(spark, xyz, slope=slope, intercept=[float(k % 2) for k in range(25)])
    left = {r.uid for r in registration.smooth_pairs(p, ["cell"], "uid", sigma=3.0).collect()}
    assert 12 not in left and len(left) >= 20


def test_neighbours_that_overlap(spark):
    p = spark.createDataFrame([(1, 0, 10), (1, 5, 20), (1, 18, 30), (1, 40, 50), (2, 0, 10), (2, 10, 20)], "region int, start int, end int")
    assert sorted((r.region, r.start) for r in library.not_overlapping(p, "region").collect()) == [(1, 18), (1, 40), (2, 0), (2, 10)]


# ---- homologs ----


def two_homologs(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for region in range(20):
        for k, middle in enumerate((0.0, 4000.0)):
            rows.append((len(rows), *(middle + rng.normal(0, 200, 3)), 1000.0 + rng.uniform(0, 50), region, k))
        rows.append((len(rows), *rng.uniform(-4000, 8000, 3), 300.0 + rng.uniform(0, 50), region, -1))
    return spark.createDataFrame([(r[0], *map(float, r[1:5]), r[5], r[6], "c", 1) for r in rows], "uid int, z double, x double, y double, height double, region int, truth int, chr string, cell int")


def test_first_centres_lie_on_both_homologs(spark):
    df = two_homologs(spark)
    truth = {r.uid: r.truth for r in df.collect()}
    r = homologs.first_centres(df, ["cell"]).first()
    xyz = np.array([(x.z, x.x, x.y) for x in df.orderBy("uid").collect()])
    region = np.array([x.region for x in df.orderBy("uid").collect()])
    i, j = homologs.two_centres(xyz, region)
    assert {r.a, r.b} == {i, j} and sorted(truth[k] for k in (r.a, r.b)) in ([0, 1], [-1, 0], [-1, 1])
    assert homologs.two_centres(xyz[:1], region[:1]) is None


def test_groups_go_to_their_homologs(spark):
    df = two_homologs(spark).withColumn("score", F.log("height") - 7).withColumn("bad", F.col("truth") < 0)
    out = homologs.assigned(df, ["cell"], controls="bad").join(df.select("uid", "truth"), "uid").collect()
    assert len(out) >= 36 and all(r.truth >= 0 for r in out)
    of = {r.truth: r.homolog for r in out}
    assert sum(of[r.truth] == r.homolog for r in out) >= 0.95 * len(out)


def test_em_finds_the_trace(spark):
    df = two_homologs(spark).where("truth <> 1")
    picked = homologs.em_pick(df, ["cell"]).join(df.select("uid", "truth"), "uid").collect()
    assert len(picked) == 20 and sum(r.truth == 0 for r in picked) >= 19 and sum(r.kept for r in picked) >= 18
    again = homologs.em_pick(df, ["cell"], start="dynamic").collect()
    assert sum(a.uid == b.uid for a, b in zip(sorted(picked, key=lambda r: r.region), sorted(again, key=lambda r: r.region), strict=True)) >= 18


def test_population_references(spark):
    df = two_homologs(spark).where("truth <> 1").unionByName(two_homologs(spark, 5).where("truth <> 1").withColumn("cell", F.lit(2))).withColumn("channel", F.col("region") % 2)
    out = homologs.population_pick(df, ["cell"], "channel", lambda x: x, rounds=3).join(df.select("cell", "uid", "truth"), ["cell", "uid"]).collect()
    assert len(out) == 40 and sum(r.truth == 0 for r in out) >= 36


def test_permutations_for_three_copies(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=(5, 3)).round(3)
    df = spark.createDataFrame([(1, k, *map(float, v)) for k, v in enumerate(s)], "cell int, uid int, s0 double, s1 double, s2 double")
    from itertools import permutations

    best = max(sum(s[i, c] for c, i in enumerate(p)) for p in permutations(range(5), 3))
    out = homologs.permuted(df, ["cell"], "uid", ["s0", "s1", "s2"]).collect()
    assert math.isclose(sum(r.score for r in out), best) and len({r.uid for r in out}) == 3
    both = homologs.permuted(df, ["cell"], "uid", ["s0", "s1", "s2"], overlap=True).collect()
    assert [r.uid for r in sorted(both, key=lambda r: r["copy"])] == s.argmax(0).tolist()
    few = homologs.permuted(df.where("uid < 2"), ["cell"], "uid", ["s0", "s1", "s2"]).collect()
    assert len(few) == 2


def test_k_means_of_two_heaps():
    xyz = np.r_[np.random.default_rng(0).normal(0, 1, (20, 3)), np.random.default_rng(1).normal(50, 1, (20, 3))]
    labels = picking.lloyd(xyz, np.ones(40), 2)
    assert len(set(labels[:20])) == len(set(labels[20:])) == 1 and labels[0] != labels[-1] and not len(picking.lloyd(xyz[:0], np.ones(0), 2))


# ---- compartments ----


def test_points_in_hulls(spark):
    cube = np.array([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], float)
    assert compartments._in_hull(np.array([0.5, 0.5, 0.5]), cube) and compartments._in_hull(np.array([0.01, 0.5, 0.99]), cube)
    assert not compartments._in_hull(np.array([1.2, 0.5, 0.5]), cube) and not compartments._in_hull(np.array([1.01, 1.01, 1.01]), cube)
    p = cloud(spark, [*cube, (0.5, 0.5, 0.5), (5, 5, 5)], label=["A"] * 8 + ["B"] * 2)
    out = {r.uid: r.share for r in compartments.hull_shares(p, ["cell"], "uid", "label", "A", 8, 5).collect()}
    assert out[8] == 1.0 and out[9] == 0.0


def test_axes_of_a_stick(spark):
    rng = np.random.default_rng(4)
    xyz = np.outer(np.arange(30), [1.0, 2.0, 3.0]) + rng.normal(0, 0.1, (30, 3))
    df = cloud(spark, xyz, label=["A"] * 15 + ["B"] * 15)
    turned = np.array([(r.z, r.x, r.y) for r in compartments.principal_axes(df, ["cell"]).orderBy("uid").collect()])
    assert turned[:, 0].std() > 20 * turned[:, 1].std() and np.allclose(np.linalg.norm(turned[1] - turned[9]), np.linalg.norm(xyz[1] - xyz[9]))
    along = np.array([(r.z, r.x, r.y) for r in compartments.along_labels(df, ["cell"], "label").orderBy("uid").collect()])
    d = along[15:].mean(0) - along[:15].mean(0)
    assert d[0] > 0 and np.allclose(d[1:], 0, atol=1e-9) and np.allclose(np.linalg.norm(along[1] - along[9]), np.linalg.norm(xyz[1] - xyz[9]))


def test_peaks_of_a_density(spark):
    grid = np.stack(np.meshgrid(range(9), range(9), range(9), indexing="ij"), -1).reshape(-1, 3)
    v = np.exp(-((grid - [3, 4, 5]) ** 2).sum(1) / 4)
    df = spark.createDataFrame([(1, *map(int, g), float(x)) for g, x in zip(grid, v, strict=True)], "cell int, z int, x int, y int, density double")
    assert [(r.z, r.x, r.y) for r in compartments.density_peaks(df, ["cell"]).collect()] == [(3, 4, 5)]


def test_polynomials_and_lines(spark):
    rng = np.random.default_rng(5)
    xyz = rng.uniform(-5, 5, (200, 3))
    y = 2 + 3 * xyz[:, 0] - xyz[:, 1] + 0.5 * xyz[:, 0] * xyz[:, 2]
    df = cloud(spark, xyz, y2=y.tolist())
    r = fits.polynomial(df, ["cell"], F.col("y2"), 2).first()
    want = np.zeros(10)
    want[[0, 1, 2, 6]] = 2, 3, -1, 0.5
    assert np.allclose(r.coefficients, want, atol=1e-8) and math.isclose(r.r2, 1.0) and r.n == 200
    line = fits.bleed_slopes(df.withColumn("b", 4 * F.col("x") + 1), ["cell"], "x", "b").first()
    assert math.isclose(line.slope, 4) and math.isclose(line.intercept, 1) and math.isclose(line.r2, 1)


# ---- domains ----


def blocks(sizes, near=1.0, far=4.0, seed=1):
    of = np.repeat(range(len(sizes)), sizes)
    m = np.where(np.equal.outer(of, of), near, far) + np.random.default_rng(seed).uniform(0, 0.2, (len(of), len(of)))
    m = (m + m.T) / 2
    np.fill_diagonal(m, 0)
    return m


@pytest.mark.parametrize("method", sorted(domains.CALLERS))
def test_callers_find_blocks(method):
    how = {"least_effect": 1.0} if method in ("sliding", "iterative", "local") else {}
    starts = domains.CALLERS[method](blocks([10, 10, 10]), **how)
    assert len(starts) == 3 and all(abs(a - b) <= 1 for a, b in zip(starts, [0, 10, 20], strict=True))


def sliding_by_hand(m, w):
    out = np.zeros(len(m))
    for i in range(w, len(m) - w):
        inside = [m[a, b] for lo in (i - w, i) for a in range(lo, lo + w) for b in range(a + 1, lo + w) if m[a, b] > 0]
        across = [m[a, b] for a in range(i - w, i) for b in range(i, i + w)]
        p, q = np.median(inside), np.median(across)
        v = (np.median([(x - p) ** 2 for x in inside]) + np.median([(x - q) ** 2 for x in across])) / 2
        out[i] = max(0.0, (q - p) / math.sqrt(v))
    return out


def test_calls_equal_a_plain_version(spark):
    """Peaks of the sliding effect, weakest neighbours merged, per copy; shares of starts; interactions."""
    rng = np.random.default_rng(6)
    rows, want, pairs = [], {}, {}
    for copy in range(4):
        xyz = np.cumsum(rng.normal(0, 1, (30, 3)), axis=0)
        xyz[10:20] += 30 * (copy % 2)
        rows += [(copy, k, *map(float, p)) for k, p in enumerate(xyz)]
        m = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
        starts = [0, *domains.find_peaks(sliding_by_hand(m, 4), 3, 0.1).tolist()]
        while len(starts) > 1:
            ends = [*starts[1:], 30]
            force = [domains.between(m, starts[k], starts[k + 1], ends[k + 1]) for k in range(len(starts) - 1)]
            if min(force) >= 0.3:
                break
            del starts[int(np.argmin(force)) + 1]
        want[copy] = starts
        pairs[copy] = sorted(domains.interacting(m, starts, 0.5, 50.0, 0.3))
    df = spark.createDataFrame(rows, "copy int, region int, z double, x double, y double")
    called = domains.called(df, ["copy"])
    got = {}
    for r in called.orderBy("start").collect():
        got.setdefault(r["copy"], []).append(r.start)
    assert got == want
    share = {r.start: r.share for r in domains.boundary_share(called, ["copy"]).collect()}
    every = [s for v in want.values() for s in v if s]
    assert share == {s: every.count(s) / 4 for s in set(every)}
    found = {}
    for r in domains.interactions(df, ["copy"]).collect():
        found.setdefault(r["copy"], []).append((r.domain_a, r.domain_b))
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in pairs.items() if v}


def test_p_values():
    # tabulated: t = 2.228 with 10 degrees of freedom is 0.05; the 5 % limit of the KS distance for large samples is 1.358 sqrt((n + m) / nm)
    assert abs(domains.t_p(2.228, 10) - 0.05) < 2e-4 and abs(domains.t_p(1.96, 1e6) - 0.05) < 1e-3 and abs(domains.t_p(0, 5) - 1) < 1e-9
    assert abs(domains.ks_p(1.358 * math.sqrt(2 / 5000), 5000, 5000) - 0.05) < 2e-3 and domains.ks_p(0.0, 9, 9) == 1.0
    a, b = np.array([1.0, 2, 3, 4]), np.array([11.0, 12, 13, 14])
    assert domains.contrast(a, b)[0] == 1.0 and domains.contrast(a, b, "t")[1] < 0.01 and domains.contrast(a, a, "t")[0] == 0


def test_domain_correlations_and_compartments(spark):
    m = blocks([8, 8, 8, 8], 1.0, 4.0)
    m[:8, 16:24] = m[16:24, :8] = 1.5
    m[8:16, 24:] = m[24:, 8:16] = 1.5
    d = domains.correlation_distances(m, [0, 8, 16, 24])
    assert d[0, 2] < d[0, 1] and d[1, 3] < d[1, 2] and np.allclose(np.diag(d), 0)
    rows = [(i, j, float(m[i, j])) for i in range(32) for j in range(i + 1, 32)]
    pairs = spark.createDataFrame(rows, "i int, j int, median double")
    regions = spark.createDataFrame([(k, 1000 * k + 500) for k in range(32)], "region int, midpoint int")
    labels = {r.region: r.label for r in domains.compartment_calls(pairs, regions).collect()}
    runs = [{labels[k] for k in range(a + 2, a + 6)} for a in (0, 8, 16, 24)]
    assert all(len(x) == 1 for x in runs) and runs[0] == runs[2] != runs[1] == runs[3]


# ---- images ----


def beads(shape, places, height=1000.0, sigma=(1.2, 1.4, 1.4), noise=2.0, base=100.0, seed=0):
    grid = np.stack(np.meshgrid(*[np.arange(n) for n in shape], indexing="ij"))
    a = base + np.random.default_rng(seed).normal(0, noise, shape)
    for p in places:
        a += height * np.exp(-0.5 * sum(((grid[k] - p[k]) / sigma[k]) ** 2 for k in range(3)))
    return a


def table(spark, stacks, **more):
    rows = [(k, *a.shape, images.pixels_of(a), *[more[c][k] for c in more]) for k, a in enumerate(stacks)]
    return spark.createDataFrame(rows, "image int, depth int, height int, width int, pixels binary" + "".join(f", {c} {'string' if isinstance(more[c][0], str) else 'int'}" for c in more))


PLACES = [(4.3, 12.2, 15.7), (6.1, 30.4, 28.9), (5.0, 20.0, 40.5)]


def test_spots_are_fitted(spark):
    out = images.spots(table(spark, [beads((11, 44, 52), PLACES)]), ["image"], 200.0).orderBy("seed").collect()
    assert len(out) == 3
    for p in PLACES:
        r = min(out, key=lambda r: abs(r.x - p[1]) + abs(r.y - p[2]))
        assert np.allclose([r.z, r.x, r.y], p, atol=0.05) and abs(r.height - 1000) < 30 and abs(r.sigma_xy - 1.4) < 0.1 and abs(r.sigma_z - 1.2) < 0.15


def test_drift_and_warp(spark):
    a = beads((8, 40, 40), [(4, 12, 15), (4, 28, 22)])
    b = np.roll(a, (1, 3, -2), axis=(0, 1, 2))
    df = table(spark, [a, b], cell=[1, 1])
    out = {r.image: (r.shift_z, r.shift_x, r.shift_y) for r in images.drifts(df, ["cell"], "image").collect()}
    assert out == {0: (0, 0, 0), 1: (1, 3, -2)}
    shifts = images.drifts(df, ["cell"], "image")
    back = images.moved(df, shifts, ["cell", "image"]).where("image = 1").first()
    assert np.abs(images.array_of(back)[1:6, 4:34, 4:34] - images.array_of(df.first())[1:6, 4:34, 4:34]).max() <= 1
    half = images.warped(np.arange(24.0).reshape(2, 3, 4), (0, 0, 0.5))
    assert np.allclose(half[0, 0, :3], [0.5, 1.5, 2.5]) and half[0, 0, 3] == 0


def test_pixel_corrections(spark):
    a = np.full((6, 20, 20), 100.0)
    a[:, 7, 9] = 5000
    clean = images.array_of(images.hot_pixels_removed(table(spark, [a])).first())
    assert clean.max() == 100
    flat = images.array_of(images.high_pass(table(spark, [np.full((2, 16, 16), 500.0)])).first())
    assert flat.max() == 0
    x = beads((5, 30, 30), [(2, 15, 15)], noise=0)
    sharp = images.deconvolved(images.blurred(x, 1.5), 1.5, 20)
    assert sharp[2, 15, 15] > images.blurred(x, 1.5)[2, 15, 15]
    source, target = np.full((2, 8, 8), 400.0), np.full((2, 8, 8), 150.0)
    out = images.unmixed(table(spark, [source, target], channel=["a", "b"], cell=[1, 1]), ["cell"], {"b": {"a": 0.25}}).where("channel = 'b'").first()
    assert set(images.array_of(out).ravel()) == {50.0}
    tilt = {"a": np.array([[0, 0, 0, 0], [1.0, 0, 0, 0], [0, 0, 0, 0]])}
    moved = images.array_of(images.chromatic(table(spark, [np.arange(64.0).reshape(1, 8, 8)], channel=["a"]), tilt).first())
    assert moved[0, 0].tolist() == list(range(8, 16)) and not moved[0, 7].any()


def test_illumination(spark):
    x, y = np.meshgrid(np.arange(24), np.arange(24), indexing="ij")
    shade = 0.5 + 0.5 * np.exp(-((x - 12) ** 2 + (y - 12) ** 2) / 200)
    stacks = [np.round(shade[None] * v * np.ones((3, 1, 1))) for v in (800, 1000, 1200)]
    df = table(spark, stacks, channel=["a"] * 3).repartition(3)
    r = images.illumination_profile(df, low=0, high=100, sigma=1.0).first()
    p = np.array(r.profile).reshape(24, 24)
    assert p.max() == 1 and np.abs(p / p[12, 12] - shade / shade[12, 12]).max() < 0.05  # the profile is blurred twice
    out = images.illuminated(df, {"a": p}).where("image = 1").first()
    assert images.array_of(out)[0, 2:22, 2:22].std() < 0.02 * images.array_of(out).mean()


def test_masks_and_boxes(spark):
    a = np.full((4, 40, 40), 100.0) + np.random.default_rng(0).normal(0, 1, (4, 40, 40))
    a[:, 5:15, 5:15] += 900
    a[:, 25:35, 20:32] += 900
    voxels = images.masks(table(spark, [a]), ["image"], sigma=1.0)
    out = {r.label: (r.x_min, r.x_max, r.y_min, r.y_max) for r in images.boxes(voxels, ["image"]).collect()}
    assert set(out) == {1, 2} and all(abs(g - w) <= 1 for k, want in ((1, (5, 14, 5, 14)), (2, (25, 34, 20, 31))) for g, w in zip(out[k], want, strict=True))
    assert abs(images.backgrounds(table(spark, [a]), ["image"]).first().background - 100) < 3
    m = np.array([[1, 1, 0, 1], [0, 0, 0, 1], [1, 0, 0, 0]])
    assert images.labelled(m > 0).tolist() == [[1, 1, 0, 2], [0, 0, 0, 2], [3, 0, 0, 0]]
    assert images.between_planes(np.array([[1], [2]]), np.array([0, 4]), 5).ravel().tolist() == [1, 1, 1, 2, 2]
    assert images.merged_masks(np.array([1, 1, 0, 0, 0]), np.array([1, 1, 0, 2, 2])).tolist() == [1, 1, 0, 2, 2]


def test_frames_become_stacks_and_the_whole_chain_runs(spark):
    frames = spark.createDataFrame([(1, k, 2, 2, np.full(4, k, "<u2").tobytes()) for k in range(8)], "image int, frame int, height int, width int, pixels binary")
    out = {r.channel: images.array_of(r)[:, 0, 0].tolist() for r in images.stacked(frames, ["image"], 2, 1).collect()}
    assert out == {0: [1, 3, 5], 1: [2, 4, 6]}
    a, b = beads((5, 24, 24), [(2, 12, 12)]), beads((5, 24, 24), [(2, 8, 14)])
    df = table(spark, [a, b], channel=["a", "b"], fov=[1, 1])
    shifts = spark.createDataFrame([(1, 0.0, 1.0, 0.0)], "fov int, shift_z double, shift_x double, shift_y double")
    done = images.corrected(df, ["fov"], {c: np.ones((24, 24)) for c in "ab"}, {"b": {"a": 0.0}}, {}, shifts)
    top = images.array_of(done.where("channel = 'a'").first())
    assert np.unravel_index(top.argmax(), top.shape) == (2, 11, 12)


# ---- sources ----


def test_typed_tables(spark, tmp_path):
    (tmp_path / "r.csv").write_text("start,id,chr,end,midpoint,more\n1e3,1,chr1,2000.0,1500,x\n,2,chr2,bad,7,y\n")
    assert [tuple(r) for r in text.region_positions(spark, str(tmp_path / "r.csv")).collect()] == [(1, "chr1", 1000, 2000, 1500), (2, "chr2", None, None, 7)]
    (tmp_path / "c.csv").write_text("chr,start,end,midpoint,fold\nchr1,1,3,2.5,9.5\n")
    assert tuple(text.chip_peaks(spark, str(tmp_path / "c.csv")).first()) == ("chr1", 1, 3, 2.5, 9.5)
    (tmp_path / "n.csv").write_text("RNA_id,gene_name,chr,strand,start,end,midpoint\nr1,G,chr1,+,1,3,2\n")
    assert text.rna_info(spark, str(tmp_path / "n.csv")).first().gene_name == "G"
    (tmp_path / "g.csv").write_text("gene_id,gene_name,chr,TSS_position\n4,G,chr1,77\n")
    assert text.gene_info(spark, str(tmp_path / "g.csv")).first().TSS_position == 77
    (tmp_path / "b.csv").write_text("Bit,ReadoutName\n3,NDB_1\n")
    assert tuple(text.readouts(spark, str(tmp_path / "b.csv")).first()) == (3, "NDB_1")
    (tmp_path / "p.txt").write_text("1.5,-2\n3,4\n")
    assert sorted(map(tuple, text.positions(spark, str(tmp_path / "p.txt")).collect())) == [(0, 1.5, -2.0), (1, 3.0, 4.0)]
    (tmp_path / "m.json").write_text('{\n "transpose": true, "flip_vertical": false}')
    assert tuple(text.microscope(spark, str(tmp_path / "m.json")).first()) == (True, False, False)


def test_more_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one > two\nACG\nTTT\n>three\nGG")
    fa = text.fasta(spark, str(tmp_path / "a.fa"))
    assert sorted((r.name, r.seq) for r in fa.collect()) == [("one > two", "ACGTTT"), ("three", "GG")]
    text.write_fasta(fa, str(tmp_path / "out.fa"))
    assert sorted((r.name, r.seq) for r in text.fasta(spark, str(tmp_path / "out.fa")).collect()) == [("one > two", "ACGTTT"), ("three", "GG")]
    (tmp_path / "w.wig").write_text("track x\n# c\nchr1 1 5 7\n")
    assert tuple(text.wig(spark, str(tmp_path / "w.wig")).first()) == ("chr1", 1, 5, 7.0)
    m = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 2.5), ("b", "a", 2.5), ("b", "b", 0.0)], "i string, j string, value double")
    text.write_matrix(m.coalesce(1), ["a", "b"], str(tmp_path / "m"))
    assert sorted(map(tuple, text.matrix(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, m.collect()))
    (tmp_path / "t.tsv").write_text("Z(nm)\tX(nm)\tY(nm)\tGenomic coordinate\tChromosome copy number\tGene names\n1\tnan\t3\tchr21:1,000-2,000\t4\tA;B\n")
    r = text.trace_table(spark, str(tmp_path / "t.tsv")).first()
    assert (r["copy"], r.chr, r.start, r.end, r.z, r.x, r.genes) == (4, "chr21", 1000, 2000, 1.0, None, ["A", "B"])
    (tmp_path / "l.tsv").write_text("Region\tGene\nchr2:5-9\tG\n")
    assert (lambda r: (r.chr, r.start, r.Gene))(text.regions(spark, str(tmp_path / "l.tsv")).first()) == ("chr2", 5, "G")
    gff = "##gff-version 3\n##species x\nc\ts\tgene\t1\t90\t.\t+\t.\tID=g;Name=Gene\n###\nc\ts\tmRNA\t1\t90\t.\t+\t.\tID=t;Parent=g\nc\ts\texon\t1\t40\t.\t+\t.\tID=e;Parent=t\n"
    (tmp_path / "g.gff").write_text(gff)
    assert sorted(map(tuple, text.gff3_directives(spark, str(tmp_path / "g.gff")).collect())) == [("gff-version", "3"), ("species", "x")]
    assert sorted(r.section for r in text.gff3_sections(spark, str(tmp_path / "g.gff")).collect()) == [0, 1, 1]
    a = text.gff3(spark, str(tmp_path / "g.gff"))
    assert [r.id for r in text.genes_by_name(a, ["Gene"]).collect()] == ["g"]
    assert sorted((r.id, r.ancestor, r.distance) for r in text.descendants(a).collect()) == [("e", "g", 2), ("e", "t", 1), ("t", "g", 1)]
    assert [tuple(p) for p in one(spark, text.packed_points(F.lit("[1 2 3];[4.5 5 6];")))] == [(1.0, 2.0, 3.0), (4.5, 5.0, 6.0)]


def test_movies(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 60000, (6, 5, 4)).astype("<u2")
    frames = spark.createDataFrame([("m", k, 5, 4, a[k].tobytes()) for k in (3, 0, 5, 1, 4, 2)], "name string, frame int, height int, width int, pixels binary").repartition(3)
    folder = tmp_path / "H2"
    folder.mkdir()
    assert tuple(image_files.write_movies(frames, str(folder)).first()) == ("m", 6)
    back = image_files.frames(spark, f"{folder}/*.dax", f"{folder}/*.inf").orderBy("frame").collect()
    assert [np.frombuffer(r.pixels, "<u2").tolist() for r in back] == a.reshape(6, -1).tolist()
    infos = image_files.sidecars(spark, f"{folder}/*.inf")
    some = image_files.slices(infos, 1, 2, 4, (1, 4, 0, 3)).orderBy("frame").collect()
    assert [r.frame for r in some] == [1, 3] and np.frombuffer(some[1].pixels, "<u2").tolist() == a[3, 1:4, 0:3].ravel().tolist()
    (folder / "Conv_zscan_07.dax").write_bytes(b"xx")
    found = image_files.image_files(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.folder, r["round"], r.fov) for r in found] == [("H2", 2, 7), ("H2", 2, None)]
    (folder / "m.xml").write_text("<settings><acquisition><stage_position>10.5,-3</stage_position></acquisition><illumination><shutters>/data/shutter_750_647_488_s5.xml</shutters></illumination></settings>")
    s = image_files.settings(spark, f"{folder}/*.xml").first()
    assert (s.channels, s.stage_x, s.stage_y) == (["750", "647", "488"], 10.5, -3.0)
    size = image_files.image_sizes(infos, image_files.settings(spark, f"{folder}/*.xml"), 0).first()
    assert (size.depth, size.height, size.width) == (2, 5, 4)
    np.save(folder / "seg.npy", np.array([[0, 1], [2, 0]]))
    assert sorted((r.x, r.y, r.label) for r in image_files.label_images(spark, f"{folder}/*.npy").collect()) == [(0, 1, 1), (1, 0, 2)]


def test_tables_of_the_engine(spark, tmp_path):
    spots = spark.createDataFrame([(f, 1, k, 0, "c", float(k), 1.0, 2.0, 3.0) for f in (0, 1) for k in range(3)], "fov_id int, cell_id int, uid int, bit int, channel string, height double, z double, x double, y double")
    wanted = spark.createDataFrame([(0,), (1,), (2,)], "fov_id int")
    assert tables.missing(spark, str(tmp_path), "candidate_spots", wanted).count() == 3
    tables.save(spots, str(tmp_path), "candidate_spots")
    tables.save(spots.where("fov_id = 1").withColumn("height", F.col("height") + 1), str(tmp_path), "candidate_spots")
    got = tables.load(spark, str(tmp_path), "candidate_spots")
    assert sorted((r.fov_id, r.height) for r in got.collect()) == [(0, 1.0), (0, 2.0), (1, 1.0), (1, 2.0), (1, 3.0)]
    assert [r.fov_id for r in tables.missing(spark, str(tmp_path), "candidate_spots", wanted).collect()] == [2]
    with pytest.raises(ValueError):
        tables.save(spots.drop("z"), str(tmp_path), "candidate_spots")


# ---- functions ----


def test_words_of_long_texts(spark):
    rng = np.random.default_rng(0)
    s = "".join("ACGT"[k] for k in rng.integers(0, 4, 1000))
    for n, k in ((1000, 8), (129, 8), (128, 1), (7, 8), (0, 3), (300, 100)):
        t = s[:n]
        assert one(spark, dna.kmers(F.lit(t), k)) == [t[i : i + k] for i in range(n - k + 1)]
        df = spark.createDataFrame([(1, t)], "uid int, seq string")
        assert sorted((r.start, r.seq) for r in library.candidates(df, k, "uid").collect()) == [(i, t[i : i + k]) for i in range(n - k + 1)]


def test_dna_helpers(spark):
    assert one(spark, dna.base5(F.lit("ACGTn"))) == 1 + 2 * 5 + 3 * 25 + 4 * 125
    assert one(spark, dna.base5(F.lit("AC"), reverse=True)) == (4 - 2) + (4 - 1) * 5
    assert one(spark, dna.lower_runs(F.lit("ACgtTTaaG"))) == ["gt", "aa"] and one(spark, dna.masked(F.lit("ACgtN"))) == "ACNNN"
    assert one(spark, dna.unmasked_parts(F.lit("ACNNGTn"))) == ["AC", "GT"]
    assert one(spark, dna.padded(F.lit("ACGT"), F.lit(12), "TTTTTGGGCCC")) == "tttttACGTccc"
    assert one(spark, dna.padded(F.lit("acgt"), F.lit(6), "TTTTTGGGCCC")) == "TTacgt" and one(spark, dna.padded(F.lit("acgt"), F.lit(3), "T")) == "acgt"
    assert one(spark, dna.up_down(F.lit("ACGTT"), 2)).asDict() == {"up": "AC", "down": "TT"}
    name = dna.probe_name(F.lit("chr1:1-2"), F.lit("G"), F.lit(5), F.lit(77))
    assert one(spark, dna.parsed_name(name)).asDict() == {"region": "chr1:1-2", "gene": "G", "number": 5, "start": 77}


def test_array_helpers(spark):
    lit = lambda v: F.array(*[F.lit(x) for x in v])
    assert one(spark, arrays.sections(lit([1, 2, 3, 4, 5]), lit([0, 2, 3]))) == [[1, 2], [3], [4, 5]]
    assert one(spark, arrays.parts_of(lit([1, 2, 3]), lit(["a", "b", "a"]))) == {"a": [1, 3], "b": [2]}
    assert one(spark, arrays.bits_row(lit([1, 3]), 4)) == [0, 1, 0, 1]
    m = F.create_map(F.lit("a"), F.lit(1))
    assert one(spark, arrays.default(m, F.lit("a"), F.lit(0))) == 1 and one(spark, arrays.default(m, F.lit("z"), F.lit(-1))) == -1


def test_registered_names(spark):
    names = registry.register(spark)
    assert spark.sql("select reverse_complement('AAC') a, gc_share('ACGT') b, pack_bases('AAAC') c, distance3(0D, 0D, 0D, 0D, 3D, 4D) d").first() == ("GTT", 0.5, 1, 5.0) and "kmers" in names
    assert [tuple(r) for r in spark.sql("select * from kmers('ACGT', 3)").collect()] == [(0, "ACG"), (1, "CGT")]
    with pytest.raises(ValueError):
        registry.reducer("__import__", F.col("x"))


def test_cell_types(spark):
    rng = np.random.default_rng(0)
    rows = [(k, int(rng.poisson(20 if k % 2 else 2)), int(rng.poisson(3 if k % 2 else 15)), "on" if k % 2 else "off") for k in range(120)]
    df = spark.createDataFrame(rows, "cell_id int, g1 int, g2 int, kind string")
    out = celltypes.predicted(df.where("cell_id < 90"), df.where("cell_id >= 90").drop("kind"), "kind", (4,), 60).join(df.select("cell_id", "kind"), "cell_id").collect()
    assert sum(r.predicted == r.kind for r in out) >= 28 and all(0 <= r.confidence <= 1 for r in out)


def test_boxes_that_move(spark):
    b = spark.createDataFrame([(2, 5, 0, 3)], "x_min int, x_max int, y_min int, y_max int")
    out = groups.shifted_boxes(b, {"x": F.lit(1.4), "y": F.lit(-2.0)}, {"x": 6, "y": 6}).first()
    assert tuple(out) == (3, 5, 0, 1)
    u = spark.createDataFrame([("u", 2), ("u", 1), ("c", 5)], "kind string, number int")
    assert sorted(map(tuple, groups.kinds(u).collect())) == [("c", 1, [5]), ("u", 2, [1, 2])]
    p = spark.createDataFrame([(1.0,), (5.0,), (9.5,)], "x double")
    assert [r.x for r in groups.off_edges(p, {"x": 10}, 1.0).collect()] == [5.0]
    bleed = spark.createDataFrame([(0.9, 500.0, 5.0), (0.2, 500.0, 5.0), (0.9, 5.0, 5.0)], "r2 double, height double, x double")
    assert groups.bleed_gates(bleed, 0.8, (100.0, 1000.0), {"x": 10}, 1.0).count() == 1
    t = groups.merged_rounds([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3,)], "a int")])
    assert sorted(map(tuple, t.collect()), key=str) == [(1, 2), (3, None)]
    f = spark.createDataFrame([(1, 0), (1, 1), (1, 1)], "k int, flag int")
    assert compartments.flag_sets(f, ["k"]).first().flags == [0, 1]
    d = spark.createDataFrame([(0, 1, 2.0), (1, 2, 4.0), (0, 9, 99.0)], "i int, j int, d double")
    assert compartments.internal_distance(d, [], F.lit(0), F.lit(3)).first().mean_distance == 3.0
