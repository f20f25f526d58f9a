"""Each operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import HEAD, LONG, PASSAGE, SCHEMA, docs, empty, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm import bpe, chat, ctw, decontaminate, lines, near, quality, shards, tokens, toxicity

TEXTS = [(r[0], r[1] or "") for r in rows()]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


# 1


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(3)
    data = []
    for d in range(240):
        toxic = d % 4 == 0
        words = [f"plain{rng.randint(0, 400)}" for _ in range(60)]
        if toxic:
            for _ in range(5):
                words[rng.randrange(60)] = rng.choice(["vileword", "awfulname", f"lousy{rng.choice('abcdefgh')}ish"])
        data.append((d, " ".join(words), int(toxic)))
    labelled = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled.where("doc_id % 5 <> 0"))
    out = {r.doc_id: r for r in toxicity.scored(labelled, model).collect()}
    held = [d for d in range(240) if d % 5 == 0]
    assert all(out[d].predicted == int(d % 4 == 0) for d in held)
    text = data[0][1]
    assert {text[s.start : s.end].split()[0][:4] for s in out[0].spans} <= {"vile", "awfu", "lous"} and out[0].spans
    edge = {r.doc_id: r for r in toxicity.scored(docs(spark).select("doc_id", "text", "score"), model).collect()}
    assert edge[100].score == edge[101].score and 0 <= edge[108].score <= 1 and len(edge) == len({r[0] for r in rows()})
    assert toxicity.scored(empty(spark), model).count() == 0
    nothing = toxicity.fit(labelled.limit(0))
    assert all(r.predicted == int(r.score >= 0.3) for r in toxicity.scored(docs(spark), nothing).collect())


def test_toxicity_keeps_rare_words_of_large_corpora(spark):
    # 3,000 toxic documents; those of a small source are known by words that stand in five of them each
    common = [(d, f"vileword plain{d % 97} other{d % 89}", 1) for d in range(2960)]
    rare = [(5000 + d, f"{'abcdefgh'[d // 5]}rareword plain{d % 97} other{d % 89}", 1) for d in range(40)]
    clean = [(10000 + d, f"plain{d % 97} other{d % 89} fine{d % 83}", 0) for d in range(12000)]
    model = toxicity.fit(spark.createDataFrame(common + rare + clean, "doc_id long, text string, toxic int").repartition(4))
    strength = {bytes(r.entry): r.strength for r in model.lexicon.collect()}
    assert all(strength[f"{x}rareword".encode()] == strength[f"^{x}rar".encode()] == 2 for x in "abcdefgh") and b"plain1" not in strength
    texts = [(k, f"fine{k} {'abcdefgh'[k]}rareword plain{k}") for k in range(8)] + [(k, f"fine{k} plain{k} other{k}") for k in range(8, 16)]
    out = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert all(out[k].predicted == int(k < 8) for k in range(16))


@pytest.mark.parametrize("long", [(1,), (0,), (0, 1)])
def test_toxicity_learns_from_labels_of_long_documents(spark, monkeypatch, long):
    rng = random.Random(7)
    data = []
    for d in range(60):
        toxic = d % 3 == 0
        words = [f"plain{rng.randint(0, 40)}" for _ in range(2000 if int(toxic) in long else 60)]
        if toxic:
            words[3::20] = ["vileword"] * len(words[3::20])
        data.append((d, " ".join(words), int(toxic)))
    labelled = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled)
    assert all(r.predicted == r.toxic for r in toxicity.scored(labelled, model).collect())
    if long == (0, 1):
        monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 30_000)
        texts = toxicity.sample(labelled)
        assert sum(map(len, texts)) == 30_000 and all(any(t.startswith(x) for _, t, _ in data) for x in texts)
        monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 50)
        assert [len(t) for t in toxicity.sample(labelled)] == [50]


def test_toxicity_of_ties_repeated_rows_and_null_ids(spark):
    base = [(d, "badword here", 1) if d % 4 == 0 else (d, "good word here", 0) for d in range(80)]
    df = spark.createDataFrame(base + base[:8] + [(None, "badword", 1), (None, None, 0), (81, None, 1), (82, "", 0)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df.withColumn("text", F.coalesce("text", F.lit(""))))
    out = toxicity.scored(df, model).collect()
    assert len(out) == df.count() and all(r.predicted == r.toxic for r in out if r.doc_id is not None and r.doc_id < 80)
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    rows_ = toxicity.labelled(df.select("doc_id", "text"), labels, F.lit(False)).collect()
    assert Counter((r.doc_id, r.toxic) for r in rows_) == {(0, 1): 2, (1, 0): 2}


def test_toxicity_is_the_same_in_any_blocks(spark, monkeypatch):
    labelled = spark.createDataFrame([(d, f"bad{d % 9}x plain{d % 7}" if d % 3 == 0 else f"plain{d % 7} more{d % 5}", int(d % 3 == 0)) for d in range(300)], "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled)
    whole = Counter(map(str, toxicity.scored(labelled, model).collect()))
    monkeypatch.setattr(toxicity, "JOIN_BYTES", 200)
    assert Counter(map(str, toxicity.scored(labelled, model).collect())) == whole


def test_toxicity_is_fitted_in_little_memory(spark):
    # 400 documents of 500 words; with their chains all at once the driver took over 100 MB
    rng = random.Random(5)
    data = [(d, " ".join(["vileword"] * (d % 2) + [f"plain{rng.randint(0, 99)}" for _ in range(499)]), d % 2) for d in range(400)]
    labelled = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    tracemalloc.start()
    try:
        model = toxicity.fit(labelled)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print(f"peak of the fit: {peak / 1e6:.0f} MB")
    assert peak < 50e6
    assert all(r.predicted == r.toxic for r in toxicity.scored(labelled, model).collect())


def test_toxicity_field_is_the_same_in_any_pieces(monkeypatch):
    texts = [b"", b" ", *(b"bad%d plain%d odd" % (d % 9, d % 7) * (1 + d % 3) if d % 3 == 0 else b"plain%d more%d" % (d % 7, d % 5) for d in range(60)), b"plain1 bad2 " * 300, b""]
    y = np.array([0.0, 1.0, *(float(d % 3 == 0) for d in range(60)), 1.0, 0.0])
    strength, fields = {b"bad%d" % k: 3 for k in range(9)} | {b"^bad": 2, b"$odd": 1}, []
    for most in (1, 200, 1 << 20):
        monkeypatch.setattr(toxicity, "FIT_BYTES", most)
        cut = list(toxicity.runs(texts, most))
        assert [t for at in cut for t in texts[at]] == texts and all(sum(map(len, texts[at])) <= most or at.stop - at.start == 1 for at in cut)
        field = toxicity.fitted(texts, y, strength, np.ones(len(y)))
        fields.append(np.concatenate([*field.emission, [field.bias], field.switch.ravel(), field.logistic]))
    assert all(np.allclose(x, fields[-1], rtol=0, atol=1e-6) for x in fields)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    score, switch = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    got, pairs = toxicity.forward_backward(score, switch, first)
    for lo, hi in ((0, 4), (4, 7)):
        weight = {}
        for y in np.ndindex(*[2] * (hi - lo)):
            weight[y] = np.exp(sum(score[lo + k] * v for k, v in enumerate(y)) + sum(switch[a, b] for a, b in zip(y, y[1:], strict=False)))
        z = sum(weight.values())
        assert np.allclose(got[lo:hi], [sum(w for y, w in weight.items() if y[k]) / z for k in range(hi - lo)])
        assert np.isclose(pairs[lo + 1, 0, 1], sum(w for y, w in weight.items() if (y[0], y[1]) == (0, 1)) / z)
        # given that some token is toxic, as of a toxic document; given that none is, as of another
        some = {y: w for y, w in weight.items() if any(y)}
        p, steps = toxicity.clamped(got, pairs, first, np.arange(7) < 4)
        for k in range(hi - lo):
            assert np.isclose(p[lo + k], lo == 0 and sum(w for y, w in some.items() if y[k]) / sum(some.values()))
            for a, b in np.ndindex(2, 2) if k else ():
                want = sum(w for y, w in some.items() if (y[k - 1], y[k]) == (a, b)) / sum(some.values()) if lo == 0 else a == b == 0
                assert np.isclose(steps[lo + k, a, b], want)


def test_shapes_of_tokens():
    shape, size = toxicity.shapes([b"Big UPPER low x9", b"", "été mIx I".encode()])
    assert shape.tolist() == [1, 2, 0, 3, 4, 5, 1] and size.tolist() == [0, 1, 0, 0, 1, 0, 0] and len(toxicity.shapes([b"", b" "])[0]) == 0


def test_toxicity_of_held_out_documents(spark):
    out = toxicity.op1_crf_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null"), "doc_id")
    rows_ = out.where("held_out").select("score", "predicted", "toxic", "spans").collect()
    toxic, clean = [r.score for r in rows_ if r.toxic], [r.score for r in rows_ if not r.toxic]
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    missed, flagged = sum(not r.predicted for r in rows_ if r.toxic), sum(r.predicted for r in rows_ if not r.toxic)
    print(f"held out: AUC {auc:.3f}, {missed} of {len(toxic)} toxic missed, {flagged} of {len(clean)} clean flagged, {len({r.score for r in rows_})} scores")
    assert auc >= 0.94 and missed <= 0.15 * len(toxic) and flagged <= 0.02 * len(clean)
    tagged = [bool(r.spans) for r in rows_ if r.predicted and r.toxic]
    assert sum(tagged) >= 0.9 * len(tagged)


# 2 and 7


def test_bpe_equals_the_library(spark):
    enc = encoder()
    out = bpe.encoded(docs(spark).select("doc_id", "text", F.lit(1).alias("n_tokens")), RANKS, public_tokenizers.PATTERN).collect()
    want = Counter((d, len(ids := enc.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in TEXTS)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    whole = bpe.encoded(docs(spark).select("doc_id", "text"), RANKS, public_tokenizers.PATTERN, ids=True).collect()
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in whole) == Counter((d, tuple(enc.encode_ordinary(t))) for d, t in TEXTS)
    assert bpe.encoded(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_merge_replay_on_random_texts():
    enc, replay, rng = encoder(), bpe.MergeReplay(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), random.Random(1)
    letters = " \t\n\r\x0b\x1c\x85\xa0aAbeZ'sét019²_-<|日😀́‍"
    for s in ["a" * 3000, "ab" * 999, " " * 300 + "x", *["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(800)]]:
        assert replay.encode(s) == enc.encode_ordinary(s)
        assert replay.decode(replay.encode(s)) == s.encode()


def test_token_counts_equal_the_library(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    out = tokens.counted(docs(spark).select("doc_id", "text", F.lit(0).alias("n_bytes")), path).collect()
    want = Counter((d, len(x.encode()), n := len(t.encode(x, add_special_tokens=False)), n > 512) for d, x in TEXTS)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want
    assert tokens.counted(empty(spark), path).count() == 0
    rng = random.Random(2)
    for _ in range(600):
        s = "".join(rng.choice([" ", "a", "bc", " the", "\n", "'s", "<|endoftext|>", "1", ".", "é", "日本", "。", "، ", "и", "\x1c", "\u3000", "́", "|", "<"]) for _ in range(60))
        assert "".join(tokens.pieces(s, 9)) == s
        assert sum(len(t.encode(x, add_special_tokens=False)) for x in tokens.pieces(s, 9)) == len(t.encode(s, add_special_tokens=False))


def test_pieces_in_any_script_and_batches_by_bytes():
    for text in ("слово " * 3000, "句子很长。" * 3000, "शब्द, " * 3000):
        assert max(map(len, tokens.pieces(text, 1000))) < 1100
    assert tokens.batches_by_bytes([600_000, 10, 500_000, 600_000], 1 << 20) == [[0, 3], [2, 1]]


# 3


def naive_hits(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(fold))
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            iw = split(text)
            n = min(window, len(iw))
            for x in {tuple(iw[a : a + n]) for a in range(len(iw) - n + 1)} if iw else ():
                for a in range(len(w) - n + 1):
                    if tuple(w[a : a + n]) == x:
                        hit.update(range(a, a + n))
                        found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


ITEMS = [(1, PASSAGE), (2, "one TWO"), (2, "one TWO"), (10, "x"), (3, None), (4, ""), (5, "Größe été"), (6, " ".join(LONG.split()[50:75]))]


def test_decontamination_equals_brute_force(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = Counter((d, n, h, tuple(i)) for (d, _), (n, h, i) in zip(TEXTS, naive_hits([t for _, t in TEXTS], ITEMS), strict=True))
    for size in (16 << 20, 300):  # one benchmark block, and several
        monkeypatch.setattr(decontaminate, "PHRASE_BYTES", size)
        out = decontaminate.hits(docs(spark), bench).collect()
        assert Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.hit_spans), tuple(r.hit_items)) for r in out) == want
    clean = {r.doc_id: r for r in decontaminate.decontaminated(docs(spark), bench).where("doc_id is not null").collect()}
    assert clean[105].text == HEAD + "\n\nTail one." and clean[105].n_chars == len(clean[105].text) and clean[100].text is None and clean[0].text == TEXTS[0][1]
    assert decontaminate.hits(empty(spark), bench).count() == 0
    clashing = docs(spark).withColumns({"hit_spans": F.lit(5), "hit_items": F.lit("z"), "row": F.lit(1), "clean": F.lit(2)})
    kept = decontaminate.decontaminated(clashing, bench)
    assert kept.columns == clashing.columns and all((r.n_words, r.hit_spans, r.hit_items, r.row, r.clean) == (7, 5, "z", 1, 2) for r in kept.collect())
    assert all(not r.hit_items for r in decontaminate.hits(docs(spark), bench.limit(0)).collect())


# 4


def test_shards(spark):
    out = shards.sharded(docs(spark), 5).collect()
    by, groups = defaultdict(list), defaultdict(set)
    for r in out:
        by[r.shard].append(r.slot)
    assert len(out) == len(TEXTS) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = {d: len(t.encode()) + 16 for d, t in TEXTS}
    assert all(r.size == sizes[r.doc_id] and r.text_crc32 == zlib.crc32(dict(TEXTS)[r.doc_id].encode()) for r in out)
    text = dict(TEXTS)
    for r in out:
        groups[text[r.doc_id]].add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 1
    assert shards.sharded(empty(spark), 5).count() == 0
    hot = spark.createDataFrame([(k, "same" if k < 60 else f"t{k // 2}") for k in range(100)], "doc_id long, text string")
    spread = Counter(r.shard for r in shards.sharded(hot, 8).collect())
    assert sorted(spread.values()) == [12] * 4 + [13] * 4


def propagated(rows, n_shards):
    """Balanced label propagation over (doc_id, text) in plain Python: the shard of each row."""
    import xxhash

    md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    key = lambda d: (d is not None, d or 0)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    docs_ = sorted(({"id": d, "g": md5(t), "size": len((t or "").encode()) + 16} for d, t in rows), key=lambda r: (r["g"], key(r["id"]), r["size"]))
    count, seen = Counter(r["g"] for r in docs_), Counter()
    for r in docs_:
        r["k"], r["n"] = seen[r["g"]], count[r["g"]]
        seen[r["g"]] += 1
    room = [len(docs_) // n_shards + (s < len(docs_) % n_shards) for s in range(n_shards)]
    for at, r in enumerate(sorted(docs_, key=lambda r: (key(r["id"]), r["g"], r["k"]))):
        r["shard"] = at % n_shards

    def cut(rs):
        held = defaultdict(Counter)
        for r in rs:
            held[r["g"]][r["shard"]] += 1
        return sum(sum(c.values()) - max(c.values()) for c in held.values())

    best = cut(docs_)
    while best:
        held = defaultdict(Counter)
        for r in docs_:
            if r["n"] > 1:
                held[r["g"]][r["shard"]] += 1
        tie = lambda g, s: signed(xxhash.xxh64(s.to_bytes(4, "little"), seed=xxhash.xxh64(g.encode(), seed=42).intdigest()).intdigest())
        wish = {g: sorted(c, key=lambda s: (-c[s], tie(g, s))) for g, c in held.items()}  # noqa: B023
        new, left, rest, claimed = [], list(room), [], Counter()
        for r in sorted((r for r in docs_ if r["n"] > 1), key=lambda r: (-r["n"], r["g"], r["k"])):
            choice = r["k"] // max(max(room), 1)
            to = wish[r["g"]][choice] if choice < len(wish[r["g"]]) else None
            if to is not None and claimed[to] < room[to]:
                claimed[to] += 1
                left[to] -= 1
                new.append({**r, "shard": to})
            else:
                rest.append(r)
        rest += [r for r in docs_ if r["n"] == 1]
        places = [s for s, free in enumerate(left) for _ in range(free)]
        new += [{**r, "shard": s} for r, s in zip(sorted(rest, key=lambda r: (-r["n"], r["g"], r["k"], key(r["id"]))), places, strict=True)]
        after = cut(new)
        if after >= best:
            break
        docs_, best = new, after
    return Counter((r["id"], r["size"], r["g"], r["shard"]) for r in docs_), best


def test_shards_equal_a_plain_version(spark):
    rng = random.Random(12)
    for n, shards_, kinds in ((120, 5, 30), (90, 8, 6), (60, 7, 60), (41, 40, 9), (5, 8, 2)):
        data = [(rng.choice([d, d, None]), f"text {min(rng.randrange(kinds), rng.randrange(kinds))}") for d in range(n)]
        want, cut = propagated(data, shards_)
        df = spark.createDataFrame(data, "doc_id long, text string")
        text = {hashlib.md5(t.encode()).hexdigest(): zlib.crc32(t.encode()) for _, t in data}
        got = Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in shards.sharded(df, shards_).collect())
        assert got == Counter({(d, size, text[g], s): k for (d, size, g, s), k in want.items()})
        most = sum(c - 1 for c in Counter(t for _, t in data).values())
        assert cut < most if n > shards_ else cut == most  # shards of one row cut every link


def test_shards_go_on_while_fewer_links_are_cut(spark, monkeypatch):
    cuts = iter([9, 7, 5, 4, 3, 2, 2])
    moves = []
    monkeypatch.setattr(shards, "cut", lambda now: next(cuts))
    monkeypatch.setattr(shards, "move", lambda now, room: moves.append(1) or now)
    assert shards.sharded(docs(spark), 5).count() == len(TEXTS) and len(moves) == 6


# 5


def test_chat(spark):
    data = [(1, 0, "user", "hi <|im_end|>\n<\\|x|>"), (1, 1, "assistant", None), (1, 2, "assistant", "a<"), (2, None, None, "x"), (2, 0, "tool\\n\nline", "<|"), (None, 3, "assistant", "y"), (3, 0, "assistant", "z" * 5000)]
    data += [(4, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(200)] + [(1, 2, "assistant", "a<")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digests(chat.formatted(df.withColumn("at", F.lit(5)))).collect()}
    for conv in {x[0] for x in data}:
        own = sorted((x for x in data if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        own = [(x[2] or "", x[3] or "") for x in own]
        loss = "".join(t for r, t in own if r == "assistant")
        got = out[conv]
        assert got.n_turns == len(own) and got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got.loss_chars == len(loss) and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got.stable
        assert got.formatted_chars == len(chat.chatml(own)) and chat.read_back(chat.chatml(own)) == own
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_chat_with_ids_of_strings(spark, tmp_path):
    spark.createDataFrame([("x", "0", "user", "q"), ("x", "1", "assistant", "a")], "conv_id string, turn string, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in chat.op5_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(out) == {"x", "-1"} and out["x"].loss_chars == 1 and out["-1"].n_turns == 2 and out["-1"].loss_chars == len("<|im_end|><|im_start|>assistant ok")


def test_chat_is_the_same_under_any_partitioning(spark, monkeypatch):
    late = lambda turns: "".join(f"[{r}]{t.upper() if k == 0 and len(turns) >= 40 else t};" for k, (r, t) in enumerate(turns))
    df = spark.createDataFrame([(c, k, "user" if k % 2 else "assistant", f"turn {k} of {c}") for c in range(5) for k in range(40 * c)], "conv_id long, turn long, role string, text string")
    results = []
    for parts in ("1", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        monkeypatch.setattr(chat, "BATCH_CHARS", int(parts) * 100)
        results.append(sorted((r.conv_id, r.formatted, str(r.spans), r.stable) for r in chat.formatted(df, late).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] and [r[3] for r in results[0]] == [False] * 4


def test_rewriting_template_is_seen():
    forget = lambda turns: "".join(f"[{r}]{t if k == len(turns) - 1 else t[:2]};" for k, (r, t) in enumerate(turns))
    assert not chat.render([("user", "hello"), ("assistant", "world")], forget)[2]
    text, spans, stable = chat.render([("user", "hello"), ("assistant", "world")])
    assert stable and [text[s[2] : s[3]] for s in spans] == ["hello", "world"]


def test_templates_see_all_turns_before(spark):
    numbered = lambda turns: "preamble;" + "".join(f"{k}[{r}]{t};" for k, (r, t) in enumerate(turns))
    # the first turn is rewritten once the 70th is there
    late = lambda turns: "".join(f"[{r}]{t.upper() if k == 0 and len(turns) >= 70 else t};" for k, (r, t) in enumerate(turns))
    own = {c: [("user" if k % 2 else "assistant", f"turn {k} of {c}") for k in range(n)] for c, n in ((1, 3), (2, 33), (3, 64), (4, 150))}
    df = spark.createDataFrame([(c, k, r, t) for c, x in own.items() for k, (r, t) in enumerate(x)], "conv_id long, turn long, role string, text string").repartition(7)
    for template in (numbered, late):
        out = chat.formatted(df, template).collect()
        assert len(out) == len(own)
        for r in out:
            text, spans, stable = chat.render(own[r.conv_id], template)
            assert r.formatted == text == template(own[r.conv_id]) and [(s.start, s.end, s.text_start, s.text_end) for s in r.spans] == spans
            assert r.stable == stable == (template is numbered or r.conv_id != 4)


# 6


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_banded_alignment_equals_full():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.integers(0, rng.choice([3, 50]), rng.integers(1, 60)).astype(np.uint64)
        b = list(a)
        for _ in range(rng.integers(0, 9)):
            k = rng.integers(0, len(b) + 1)
            b[k : k + rng.integers(0, 2)] = rng.integers(0, 50, rng.integers(0, 2)).astype(np.uint64).tolist()
        b = np.array(b or [1], np.uint64)
        m = lcs(a.tolist(), b.tolist())
        assert near.aligned(a, b) == (5 * m >= 4 * (len(a) + len(b) - m))


def test_near_duplicates(spark):
    out = near.classes(docs(spark)).collect()
    assert len(out) == len(TEXTS)
    of = {r.doc_id: r.class_id for r in out}
    assert of[3] == of[103] == of[104] == 3 and of[110] == of[111] == 110 and of[100] == of[101] == 100 and of[108] == 108 and of[5] == 5
    kept = near.deduped(docs(spark)).collect()
    assert Counter(r.doc_id for r in kept) == Counter(set(of.values())) and len(kept[0]) == len(docs(spark).columns)
    assert near.classes(empty(spark)).count() == 0 and near.deduped(empty(spark)).count() == 0


def test_chains_and_crowds_of_copies_join(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(200)]
    data = [(0, " ".join(base))]
    for d in range(1, 60):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(200)] = f"c{d}x{rng.randrange(99)}"
        data.append((d, " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(60))
    data += [(1000 + d, passage + " " + " ".join(f"q{d}y{k}" for k in range(140))) for d in range(40)]
    of = {r.doc_id: r.class_id for r in near.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {of[d] for d in range(60)} == {0} and all(of[1000 + d] == 1000 + d for d in range(40))


def qualifying(texts):
    """Pairs of texts whose similarity is 0.8 or more, by full tables; a bound on common shingles spares hopeless ones."""
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = [word.findall((t or "").encode().translate(near.FOLD)) for _, t in texts]
    runs = [[tuple(w[k : k + min(5, len(w))]) for k in range(max(len(w) - 4, 1))] if w else [] for w in split]
    bags = [Counter(r) for r in runs]
    out = []
    for i, a in enumerate(runs):
        for j in range(i):
            b = runs[j]
            need = 4 * (len(a) + len(b))
            if a and b and 9 * min(len(a), len(b)) >= need and 9 * (bags[i] & bags[j]).total() >= need and 9 * lcs(a, b) >= need:
                out.append((texts[j][0], texts[i][0]))
    return out


def test_near_duplicates_recall(spark, monkeypatch):
    """All pairs by brute force: of 40 texts in six versions each, with ever more words changed, moved or dropped; and of the ids
    divisible by 50 against all of a given table."""
    rng = random.Random(11)
    data = []
    for d in range(40):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(rng.choice([8, 30, 120, 300]))]
        data.append((10 * d, " ".join(base)))
        for k in range(1, 6):
            w = list(base)
            for _ in range(max(1, len(w) * k // 250)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [f"z{d}y{rng.randrange(9999)}"], [w[at], "and"]])
            data.append((10 * d + k, " ".join(w)))
    want = qualifying(data)
    for block in (near.BLOCK, 400):  # buckets in one block, and in several
        monkeypatch.setattr(near, "BLOCK", block)
        of = {r.doc_id: r.class_id for r in near.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
        found = sum(of[a] == of[b] for a, b in want)
        assert len(want) > 100 and found >= 0.99 * len(want)
        joined = {d: d for d in of}  # nothing is joined but over qualifying pairs
        for a, b in want:
            x, y = joined[a], joined[b]
            joined = {d: min(x, y) if c in (x, y) else c for d, c in joined.items()}
        assert all(joined[c] == joined[d] for d, c in of.items())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    of = {r.doc_id: r.class_id for r in near.classes(docs).collect()}
    pairs = qualifying([(r.doc_id, r.text) for r in docs.collect()])
    queries = [(a, b) for a, b in pairs if a % 50 == 0 or b % 50 == 0]
    assert sum(of[a] == of[b] for a, b in queries) >= 0.9 * len(queries) and sum(of[a] == of[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_alignment_of_long_repetitive_texts():
    a = np.tile(np.array([3, 9], np.uint64), 40_000)
    b = np.r_[a[:30_000], np.array([5, 6, 7], np.uint64), a[30_001:]]
    start = time.time()
    assert near.aligned(a, b) and not near.aligned(a, np.r_[b[:60_000], np.full(30_000, 3, np.uint64)])
    assert time.time() - start < 60


def test_near_duplicates_of_other_ids(spark):
    rows_ = [("x", "one two three four five six", 1), ("y", "one two three four five six", 2), (None, "seven eight nine", 3), (None, None, 4), ("z", "", 5), ("y", "one two three four five six", 2)]
    df = spark.createDataFrame(rows_, "doc_id string, text string, key int")
    assert Counter(r.class_id for r in near.classes(df).collect()) == {"x": 3, None: 1, "z": 2}
    assert Counter(map(tuple, near.deduped(df).collect())) == Counter([("x", "one two three four five six", 1), (None, "seven eight nine", 3), ("z", "", 5)])


# 8


def naive_ctw(train, texts, depth):
    """Recursive weighting over dictionaries of counts, bit by bit."""
    import math

    count = defaultdict(lambda: [0, 0])
    low = lambda t: bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode())

    def steps(t):
        s = b"\0" * depth + low(t) + b"\0"
        for k in range(depth, len(s)):
            node = 1
            for bit in range(7, -1, -1):
                b = s[k] >> bit & 1
                yield s[k - depth : k], node, b
                node = node * 2 + b

    below = defaultdict(set)
    for t in train:
        for c, node, b in steps(t):
            for d in range(depth + 1):
                count[c[depth - d :], node][b] += 1
                if d:
                    below[c[depth - d + 1 :], node].add(c[depth - d :])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(c, node):
        if (c, node) not in memo:
            own = kt(*count[c, node])
            memo[c, node] = own if len(c) == depth else math.log(0.5) + np.logaddexp(own, sum(weighted(x, node) for x in below[c, node]))
        return memo[c, node]

    def p(c, d, node, b):
        a = count[c[depth - d :], node]
        own = (a[b] + 0.5) / (sum(a) + 1)
        if d == depth or (c[depth - d - 1 :], node) not in count:
            return own
        w = math.exp(math.log(0.5) + kt(*a) - weighted(c[depth - d :], node))
        return w * own + (1 - w) * p(c, d + 1, node, b)

    return [sum(math.log10(p(c, 0, node, b) if (b"", node) in count else 0.5) for c, node, b in steps(t)) for t in texts]


def test_context_trees_equal_recursion(spark):
    small = [(d, t[:160]) for d, t in TEXTS if d is not None and d != 110]
    df = spark.createDataFrame(small, "doc_id long, text string").withColumn("score", F.lit(0))
    out = {r.doc_id: r for r in ctw.scored(df, F.col("doc_id") % 4 == 1).collect()}
    train = [t for d, t in small if d % 4 != 1]
    want = dict(zip([d for d, _ in small], naive_ctw(train, [t for _, t in small], ctw.DEPTH), strict=True))
    assert all(abs(out[d].score - want[d]) < 1e-6 for d in want)
    count = Counter(w for t in train for w in [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(ctw.LOWER)), b""])
    for d, t in small:  # the end is the token b""
        own = [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(ctw.LOWER)), b""]
        whole = sum(count.values()) + len(count) + 1
        assert (out[d].n_tokens, out[d].n_known, out[d].train_tokens) == (len(own), sum(count[w] > 0 for w in own), sum(count.values()))
        assert abs(out[d].base_score - sum(np.log10((count[w] + 1) / whole) for w in own)) < 1e-9 * len(own)
        assert abs(out[d].code_length * (len(t.encode()) + 1) + out[d].score * np.log2(10)) < 1e-6
    assert {r.held_out for r in out.values()} == {True, False}


def test_context_trees_edges(spark):
    out = ctw.scored(docs(spark), F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False))).collect()
    assert len(out) == len(TEXTS) and all(r.score < 0 and r.base_score <= 0 for r in out)
    assert all(r.n_tokens == 1 for r in out if r.doc_id in (100, 101, 102))
    assert ctw.scored(empty(spark), F.lit(False)).count() == 0
    unseen = ctw.scored(docs(spark).limit(3), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in unseen)


# 9


def test_line_dedup(spark):
    out = {r.doc_id: r for r in lines.deduped(docs(spark), lines=True).where("doc_id is not null").collect()}
    assert out[106].text == "Other start.\nTail two." and out[105].removed_lines == [] and out[107].text == HEAD
    assert out[103].removed_lines == [0, 1] and out[100].text is None and out[108].removed_lines == []
    kept = lines.deduped(docs(spark))
    assert kept.columns == docs(spark).columns and kept.where("doc_id = 103").count() == 0 and kept.where("doc_id = 110").count() == 2
    assert lines.deduped(empty(spark)).count() == 0


def test_line_dedup_of_other_ids_and_any_columns(spark):
    run = "\n".join(f"{k} a shared line of text with some words in it" for k in range(8))
    df = spark.createDataFrame([("b", run + "\nown b", 1), ("a", "head\n" + run, 2), (None, run, 3), ("c", None, 4)], "doc_id string, text string, d int")
    df = df.withColumns({c: F.col("d") for c in ("h", "gone", "row", "n_lines", "i", "line", "seg")})
    out = lines.deduped(df)
    assert out.columns == df.columns
    got = {r.d: r for r in out.collect()}
    assert {k: r.text for k, r in got.items()} == {1: "own b", 2: "head", 3: run, 4: None}  # null ids come first
    assert all((r.h, r.gone, r.row, r.n_lines, r.seg) == (k,) * 5 for k, r in got.items())
    assert {r.d: r.removed_lines for r in lines.deduped(df, lines=True).collect()} == {1: list(range(8)), 2: list(range(1, 9)), 3: [], 4: []}


def test_line_runs_equal_brute_force(spark):
    rng = random.Random(6)
    data = [(d, "\n".join(rng.choice(["a b", "c", "d e f", "", f"u{d}"]) for _ in range(rng.randint(0, 30)))) for d in range(30)]
    least = 6
    seq = {d: [(k, x) for k, x in enumerate(t.split("\n")) if x.strip()] for d, t in data}
    places = [(d, i) for d in seq for i in range(len(seq[d]))]
    want = {d: set() for d in seq}
    for n, (d, i) in enumerate(places):
        for e, j in places[:n]:
            k = 0
            while i + k < len(seq[d]) and j + k < len(seq[e]) and seq[d][i + k][1] == seq[e][j + k][1]:
                k += 1
            if sum(len(x.split()) for _, x in seq[d][i : i + k]) >= least:
                want[d].update(x for x, _ in seq[d][i : i + k])
    got = {r.doc_id: set(r.removed_lines) for r in lines.deduped(spark.createDataFrame(data, "doc_id long, text string"), least, lines=True).collect()}
    assert got == want


# 10


def test_quality(spark):
    out = quality.judged(docs(spark)).collect()
    assert len(out) == len(TEXTS)
    of = {r.doc_id: r for r in out}
    assert not of[100].kept and of[100].n_words == 0 and of[112].n_repeat_words == 200 and of[112].base_failed and not of[113].kept
    assert all(of[d].kept for d in range(12)) and of[108].kept
    kept = quality.filtered(docs(spark))
    assert kept.columns == docs(spark).columns and all((r.n_words, r.kept, r.score) == (7, "x", 1.5) for r in kept.collect())
    assert quality.judged(empty(spark)).count() == 0


def test_fences_follow_the_spread_of_each_source(spark):
    rng = random.Random(4)
    data = []
    for d in range(1200):
        wide = d % 2  # a source of long and short words, and one of even words
        size = [rng.randint(3, 9) if wide else rng.choice([5, 5, 6]) for _ in range(60)]
        data.append((d, " ".join("".join(rng.choice("abcdef") for _ in range(n + (d % 5 if wide else 0))) for n in size), "en", f"src{wide}"))
    data += [(2000 + k, " ".join("abcdefgh" + "ijkl"[k] * 4 + str(x) for x in range(60)), "en", f"src{k % 2}") for k in range(4)]  # words of 13 letters
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    fence = {r.source: r.most_word_length for r in quality.thresholds(quality.rates(df)).collect()}
    values = {x: sorted(len(t.replace(" ", "")) * 100 // 60 for _, t, _, s in data if s == x) for x in ("src0", "src1")}
    floor = lambda v: v >> max(v.bit_length() - 6, 0) << max(v.bit_length() - 6, 0)
    at = lambda v, p: floor(v[-(-len(v) * p // 100) - 1])
    for x, v in values.items():
        assert fence[x] == at(v, 50) + max(quality.REACH * (at(v, 75) - at(v, 50)), quality.GUARD["word_length"])
    assert fence["src1"] > 2 * fence["src0"]
    out = {r.doc_id: r.kept for r in quality.judged(df).collect()}
    assert all(out[d] for d in range(1200)) and not out[2000] and not out[2002] and out[2001] and out[2003]


def test_sketches_merge_exactly(spark):
    df = quality.rates(docs(spark))
    whole = quality.sketches(df, list(quality.GUARD)).collect()
    parts = quality.sketches(df.where("lang = 'en'"), list(quality.GUARD)).unionAll(quality.sketches(df.where("lang is null or lang <> 'en'"), list(quality.GUARD)))
    assert Counter(map(tuple, whole)) == Counter(map(tuple, parts.collect()))
    for v in (0, 5, 63, 64, 1000, 123456):
        b = spark.sql(f"select shiftleft(shiftright({v}L, greatest(length(bin({v}L)) - 6, 0)), greatest(length(bin({v}L)) - 6, 0)) b").first().b
        assert b <= v <= b * 33 / 32 + 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tracemill.llm import common

    context = lambda master: SimpleNamespace(getCheckpointDir=lambda: None, master=master)
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_folder(SimpleNamespace(sparkContext=context(master), conf={}))


@pytest.mark.parametrize("schema", [SCHEMA])
def test_cases_have_what_they_promise(schema):
    assert any(r[1] is None for r in rows()) and len(LONG) > 50_000
