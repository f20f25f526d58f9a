"""The pipeline's rows against a plain version of its five stages."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
from cases import docs
from pyspark.sql.functions import lit
from test_edges import ITEMS, encoder, naive_hits, qualifying

import corpus_pipeline
from tracemill.llm import lines, quality

WS = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def rules(rows):
    """Quality rules: counts, quantiles by sorting, fences."""
    floor = lambda v: v >> max(v.bit_length() - 6, 0) << max(v.bit_length() - 6, 0)
    rates, failed = {}, {}
    for k, (_, text, lang, source) in enumerate(rows):
        t = text or ""
        w, ln = WS.findall(t), [x for x in t.split("\n") if WS.search(x)]
        windows = defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        repeated = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
        failed[k] = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        chars = sum(map(len, w))
        part = lambda a, b, s: s * a // b if b else None
        rates[k] = {
            "mark_rate": part(sum(c in quality.MARKS for c in t), chars, 10000), "dup_line_rate": part(len(ln) - len(set(ln)), len(ln), 10000),
            "capital_rate": part(sum("A" <= c <= "Z" for c in t), chars, 10000), "word_length": part(chars, len(w), 100),
        }
    groups = defaultdict(list)
    for k, (_, _, lang, source) in enumerate(rows):
        for g in (("own", lang, source), ("lang", lang), ("all",)):
            groups[g].append(k)

    def fence(g, rate):
        v = sorted(floor(rates[k][rate]) for k in groups[g] if rates[k][rate] is not None)
        at = lambda p: v[-(-len(v) * p // 100) - 1]
        return at(50) + max(quality.REACH * (at(75) - at(50)), quality.GUARD[rate]) if v else None

    def most(g):
        return max((sum(rates[k][r] is not None for k in groups[g]) for r in quality.GUARD), default=0)

    kept = []
    for k, row in enumerate(rows):
        g = next((g for g in (("own", row[2], row[3]), ("lang", row[2])) if most(g) >= quality.LEAST_DOCS), ("all",))
        if not failed[k] and all(rates[k][r] is None or fence(g, r) is None or rates[k][r] <= fence(g, r) for r in quality.GUARD):
            kept.append(row)
    return kept


def without_later_runs(rows, least=lines.LEAST_WORDS):
    """Line dedup: every pair of places is compared."""
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    seq = [[(k, x.strip(" "), len(WS.findall(x))) for k, x in enumerate(t.split("\n")) if WS.search(x)] for _, _, t in order]
    gone = defaultdict(set)
    where = defaultdict(list)
    for d, s in enumerate(seq):
        for i, (_, x, _) in enumerate(s):
            for e, j in where[x]:
                n = 0
                while i + n < len(s) and j + n < len(seq[e]) and s[i + n][1] == seq[e][j + n][1]:
                    n += 1
                if sum(y[2] for y in s[i : i + n]) >= least:
                    gone[d].update(y[0] for y in s[i : i + n])
            where[x].append((d, i))
    number = {x: d for d, x in enumerate(order)}
    out = []
    for r in rows:
        cut = gone[number[(r[0] is not None, r[0] or 0, r[1] or "")]]
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in cut) if cut else r[1]
        if not cut or WS.search(text):
            out.append((r[0], text, *r[2:]))
    return out


def one_of_each(rows):
    """Near-dedup: classes over all qualifying pairs; the least id stays."""
    texts = sorted({r[1] or "" for r in rows})
    label = list(range(len(texts)))
    for a, b in qualifying(list(enumerate(texts))):
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    of = {t: label[k] for k, t in enumerate(texts)}
    best = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        best.setdefault(of[r[1] or ""], r)
    return list(best.values())


def clean(rows):
    """Decontamination: words of any occurrence go, from the first to the last of each run."""
    word, out = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), []
    for r in rows:
        raw = (r[1] or "").encode()
        at = [m.span() for m in word.finditer(raw.lower())]  # bytes: A-Z only
        w = [raw[a:b].lower() for a, b in at]
        hit = set()
        for _, text in ITEMS:
            iw = word.findall((text or "").encode().lower())
            n = min(10, len(iw))
            for x in {tuple(iw[a : a + n]) for a in range(len(iw) - n + 1)} if iw else ():
                hit |= {p for a in range(len(w) - n + 1) if tuple(w[a : a + n]) == x for p in range(a, a + n)}
        parts, done = [], 0
        for p in sorted(hit):
            if p - 1 not in hit:
                parts.append(raw[done : at[p][0]])
            done = at[p][1]
        out.append((r[0], b"".join([*parts, raw[done:]]).decode()))
    return out


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("r", "s", "t", "v") for c in ("an", "el", "is", "on", "ur", "ix")]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    passage = [sentence(12) for _ in range(6)]
    made = []
    for d in range(200, 260):
        text = "\n".join(sentence(rng.randint(8, 16)) for _ in range(rng.randint(3, 9)))
        made.append((d, text))
        if d % 5 == 0:
            w = text.split(" ")
            w[len(w) // 2] = "changed"
            made.append((d + 100, " ".join(w)))
        if d % 9 == 0:
            made.append((d + 200, text + "\n" + "\n".join(passage)))
        if d % 14 == 0:
            made.append((d + 300, text + "\n" + ITEMS[0][1] + "\nThe end of it."))
        if d % 20 == 0:
            made.append((d + 400, text.upper().replace(" ", "!! ")))
    extra = [(d, t, "en", f"src{d % 2}", len(t)) for d, t in made]
    base = docs(spark).select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [tuple(r) for r in base] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # clashing names pass through all stages but the last
    for c in ("row", "key", "d", "n_words", "hit_spans", "kept", "stays"):
        df = df.withColumn(c, lit(f"own {c}"))
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = clean(one_of_each(without_later_runs(rules([r[:4] for r in rows]))))
    enc = encoder()
    want = Counter((d, len(ids := enc.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in left)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert 50 < len(left) < len(rows) - 10 and all(c in got[0].asDict() for c in ("row", "kept", "stays"))


def test_pipeline_on_an_empty_table_leaves_one_folder(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "n_tokens" in out.columns
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file://")) if out.inputFiles() else None
    assert folder is None or os.listdir(os.path.dirname(folder)) == [f"4-{corpus_pipeline.STAGES[-1][0]}"]


def test_hits_of_the_plain_version_agree():
    text = "x " + ITEMS[0][1] + " y"
    assert naive_hits([text], ITEMS)[0][1] == len(ITEMS[0][1].split()) + 1 and "passage0" not in clean([(1, text)])[0][1]
    assert public_tokenizers.PATTERN
