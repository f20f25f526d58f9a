"""Small cases with results worked out by hand."""

import math

import numpy as np
from pyspark.sql import functions as F

from tracemill.functions import dna, geometry
from tracemill.operators import aggregates, decode, domains, joins, library, picking, windows
from tracemill.sources import images, text
from tracemill.streaming import ingest


def one(spark, e):
    return spark.range(1).select(e.alias("x")).first().x


def test_words_pack_into_two_bits_a_base(spark):
    assert [one(spark, dna.pack(F.lit(s))) for s in ("ACGT", "AAAC", "NNNN")] == [27, 1, 0]
    assert one(spark, dna.pack(dna.reverse_complement(F.lit("AAAC")))) == 191


def test_word_counts_and_hits(spark):
    t = library.word_table(spark.createDataFrame([("ACACA",)], "seq string"), 2)
    assert {r.word: r.n for r in t.collect()} == {"AC": 2, "CA": 2}
    p = spark.createDataFrame([(1, "ACA"), (2, "TGT")], "uid int, seq string")
    assert {r.uid: r.hits for r in library.hits(p, t, 2, "uid").collect()} == {1: 4, 2: 0}
    assert {r.uid: r.hits for r in library.hits(p, t, 2, "uid", reverse=True).collect()} == {1: 0, 2: 4}


def test_first_code_wins_a_shared_pair(spark):
    codes = spark.createDataFrame([(r, b) for r, bits in {7: (1, 4, 9), 8: (1, 4, 10)}.items() for b in bits], "region_id int, bit int")
    assert {(r.bit_a, r.bit_b): r.region_id for r in decode.valid_pairs(codes).collect()} == {(1, 4): 7, (1, 9): 7, (4, 9): 7, (1, 10): 8, (4, 10): 8}


def points(spark, xs, **more):
    rows = [(k, 0.0, float(x) if x is not None else None, 0.0, *[v[k] for v in more.values()]) for k, x in enumerate(xs)]
    return spark.createDataFrame(rows, "uid int, z double, x double, y double" + "".join(f", {c} double" for c in more)).withColumn("cell", F.lit(1))


def test_radius_is_closed_and_crosses_buckets(spark):
    p = joins.radius_pairs(points(spark, [0, 100, 250, None]), 150.0, ["cell"], "uid")
    assert sorted((r.l.uid, r.r.uid) for r in p.collect()) == [(0, 1), (1, 2)]


def test_radius_join_finds_all_pairs(spark):
    rng = np.random.default_rng(0)
    xyz = rng.uniform(-500, 500, (120, 3))
    df = spark.createDataFrame([(k, *map(float, v), 1) for k, v in enumerate(xyz)], "uid int, z double, x double, y double, cell int")
    got = {(r.l.uid, r.r.uid) for r in joins.radius_pairs(df, 130.0, ["cell"], "uid").collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if np.linalg.norm(xyz[i] - xyz[j]) <= 130}


def test_shares(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 3.0, 4.0, None)], "k int, v double")
    at3 = lambda mode, up: windows.ecdf(df, "v", ["k"], mode, up).where("v = 3").first().score
    assert at3("weak", True) == 0.75 and at3("strict", True) == 0.5 and at3("a", True) == 0.875 and at3("a", False) == 0.375
    assert math.isclose(at3("b", True), 2 / 3) and math.isclose(at3("b", False), 1 / 3)


def test_contact_rules(spark):
    df = spark.createDataFrame([(400.0,), (500.0,), (600.0,), (None,)], "d double")
    got = [df.agg(aggregates.contact(F.col("d"), 500.0, *how).alias("x")).first().x for how in (("<=", "skip"), ("<", "skip"), ("<>", "skip"), ("<", "no"))]
    assert [round(x, 6) for x in got] == [round(2 / 3, 6), round(1 / 3, 6), 0.5, 0.25]


def test_gyration_and_scores(spark):
    assert aggregates.radius_of_gyration(points(spark, [0, 2]), ["cell"]).first().rg == 1.0
    assert math.isclose(one(spark, geometry.exp_distance_score(F.lit(2000.0))), -math.e) and math.isclose(one(spark, geometry.log_distance_score(F.lit(2000.0))), math.log(2))


def test_interval_ends(spark):
    p = spark.createDataFrame([("a", 100), ("a", 200), ("b", 150)], "chr string, at long")
    g = spark.createDataFrame([("a", 100, 200)], "chr string, start long, end long")
    assert sorted(r.p.at for r in joins.interval_join(p, g, "at").collect()) == [100, 200]
    assert [r.p.at for r in joins.interval_join(p, g, "at", closed=False).collect()] == [100]


def test_mutual_partners(spark):
    out = joins.mutual_unique(points(spark, [0, 10, 11]), points(spark, [0.5, 10.4]), 2.0, ["cell"], "uid", "uid").collect()
    assert [(r.a, r.b) for r in out] == [(0, 0)]


def test_duplicates(spark):
    p = points(spark, [0, 10], height=[9.0, 5.0])
    assert [r.uid for r in decode.suppressed(p, 150.0, ["cell"]).collect()] == [0]
    assert decode.suppressed(p, 150.0, ["cell"], mode="literal").collect() == []


def test_two_copies(spark):
    c = spark.createDataFrame([(1, 0, 5.0, 4.9), (1, 1, 4.0, 1.0), (2, 5, 1.0, 2.0)], "k int, uid int, s0 double, s1 double")
    out = {r.k: (r.copy0, r.copy1) for r in picking.pair_assignment(c, ["k"], "uid", F.col("s0"), F.col("s1")).collect()}
    assert out == {1: (1, 0), 2: (None, 5)}


def test_loop_out(spark):
    t = points(spark, [0, 100, 1700, 3400, 3500]).withColumn("region", F.col("uid"))
    assert [r.uid for r in windows.loop_outs(t, ["cell"], "region", 1500.0).where("loop_out").collect()] == [2]


def test_runs_merge(spark):
    assert domains.merged_runs(np.array([0, 0, 0, 0, 1, 0, 0, 0, 0])).tolist() == [0] * 9


def test_peaks():
    assert domains.find_peaks(np.array([0, 1, 0, 3, 3, 3, 0, 2, 0.0])).tolist() == [1, 4, 7]
    assert domains.find_peaks(np.array([0, 1, 0, 3, 3, 3, 0, 2, 0.0]), distance=3).tolist() == [1, 4, 7]
    assert domains.find_peaks(np.array([0, 1, 0.5, 3, 0]), prominence=0.6).tolist() == [3]


def test_blocks_become_domains():
    n = 24
    m = np.where(np.equal.outer(np.arange(n) // 8, np.arange(n) // 8), 1.0, 4.0) + np.random.default_rng(1).uniform(0, 0.2, (n, n))
    m = (m + m.T) / 2
    assert domains.call(m) == [0, 8, 16]


def test_normalised_by_channel(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 10.0), ("b", 30.0)], "c string, h double")
    assert sorted(round(r.h, 6) for r in geometry.normalised(df, "h", ["c"]).collect()) == [0.5, 0.666667, 1.333333, 1.5]


def test_melting_temperature_by_hand(spark):
    # AT, TG, GC, CA stacks; one terminal AT pair at each end
    h = -7.2 - 8.5 - 9.8 - 8.5 + 0.2 + 2 * 2.2
    s = -20.4 - 22.7 - 24.4 - 22.7 - 5.7 + 2 * 6.9 + 0.368 * 4 * math.log(0.39)
    want = 1000 * h / (s + 1.987 * math.log(1e-9)) - 273.15
    assert math.isclose(one(spark, dna.melting_temperature(F.lit("ATGCA"))), want)


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACG\nTTT\n>two\nGG\n")
    assert sorted((r.name, r.seq) for r in text.fasta(spark, str(tmp_path / "a.fa")).collect()) == [("one x", "ACGTTT"), ("two", "GG")]
    (tmp_path / "b.bed").write_text("#c\nchr1 10 20 n 5\nchr1\t30\t40\n")
    assert [(r.start, r.score) for r in text.bed(spark, str(tmp_path / "b.bed")).collect()] == [(10, 5.0), (30, 1.0)]
    (tmp_path / "g.gff").write_text("##gff-version 3\nc\ts\tgene\t1\t90\t.\t+\t.\tID=g\nc\ts\tmRNA\t1\t90\t.\t+\t.\tID=t;Parent=g\nc\ts\texon\t1\t40\t.\t+\t.\tParent=t\n")
    assert [(r.gene, r.transcript, r.end) for r in text.gene_parts(text.gff3(spark, str(tmp_path / "g.gff"))).collect()] == [("g", "t", 40)]
    (tmp_path / "u.csv").write_text("Hyb,750,647\nH0,u12,c3\nH1,,beads\n")
    assert sorted((r["round"], r.kind, r.number) for r in text.colour_usage(spark, str(tmp_path / "u.csv")).collect()) == [("H0", "c", 3), ("H0", "u", 12), ("H1", "beads", None)]
    assert one(spark, text.region_name(F.lit("chr2:1,000-2,000"))).asDict() == {"chr": "chr2", "start": 1000, "end": 2000}
    (tmp_path / "i.inf").write_text("frame dimensions = 2 x 3\nnumber of frames = 2\nbig endian\nStage X = -1.5\n")
    (tmp_path / "i.dax").write_bytes(np.arange(12, dtype=">u2").tobytes())
    rows = images.frames(spark, str(tmp_path / "*.dax"), str(tmp_path / "*.inf")).orderBy("frame").collect()
    assert np.frombuffer(rows[1].pixels, "<u2").tolist() == list(range(6, 12))


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(f, u, float(u)) for f in (0, 1) for u in range(3)], "fov_id int, uid int, x double")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.overwrite_fovs(ingest.stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.fov_id, r.uid) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted((r.fov_id, r.uid) for r in df.collect())


def test_flags_by_overlap(spark):
    rows = [("g", "exon", 1, 10), ("g", "exon", 1, 10), ("g", "utr3", 8, 12)]
    out = library.flags(spark.createDataFrame(rows, "gene string, kind string, start long, end long"), {"exon": 2, "utr3": 3})
    assert sorted((r.start, r.end, r.flag) for r in out.collect()) == [(1, 7, 2), (8, 10, 6), (11, 12, 3)]


def test_swap_of_a_part(spark):
    assert one(spark, dna.swapped(F.lit("AAACCCGGG"), 4, F.lit("TTT"))) == "AAATTTGGG"
    assert one(spark, dna.swapped(F.lit("AAACCCGGG"), -3, F.lit("TTT"))) == "AAACCCTTT"


def test_complete_linkage():
    x = np.array([0.0, 1.0, 10.0, 11.0, 30.0])
    d = np.abs(x[:, None] - x[None])
    assert domains.complete_linkage(d, 3).tolist() == [0, 0, 1, 1, 2] and domains.complete_linkage(d, 2).tolist() == [0, 0, 0, 0, 1]


def test_interacting_domains():
    m = np.full((15, 15), 100.0)
    for a, b in ((0, 0), (1, 1), (2, 2), (0, 2), (2, 0)):
        m[a * 5 : a * 5 + 5, b * 5 : b * 5 + 5] = 10.0
    m += np.random.default_rng(0).uniform(0, 1, m.shape)
    assert domains.interacting(m, [0, 5, 10], 2.0, 50.0, 0.5) == {(0, 2)}


def test_scheme_and_aligner_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("750,647\nnum_hyb,2\nnum_reg,2\nnum_color,2\n1,2,3,4\n5,,7,8\n")
    got = {(r.colour, r.hyb, r.region): r.value for r in text.encoding_scheme(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {("750", 0, 0): 1, ("750", 0, 1): 2, ("647", 0, 0): 3, ("647", 0, 1): 4, ("750", 1, 0): 5, ("750", 1, 1): None, ("647", 1, 0): 7, ("647", 1, 1): 8}
    spots = spark.createDataFrame([("c", 0, 1, 0.5, 0.0, 0.0)], "chr string, fiberidx int, hyb int, z_um double, x_um double, y_um double")
    regions = spark.createDataFrame([("c", 1), ("c", 2)], "chr string, hyb int")
    assert {(r.hyb, r.z) for r in text.aligned_traces(spots, regions).collect()} == {(1, 500.0), (2, None)}
