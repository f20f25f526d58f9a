"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts are cut at places where the tokenizer would cut anyway, so that pieces are little longer than ``PIECE`` characters if the text
allows (a run of letters without any break stays whole), and pieces are packed into batches of about equal bytes. The counts of a text's pieces add up to the count of the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracemill.llm.arrow import blocks, tidy, with_columns
from tracemill.llm.bpe import shipped
from tracemill.llm.common import table

PIECE, BATCH_BYTES, LIMIT = 1 << 16, 1 << 20, 512
#: Between a letter and white space or a mark of punctuation a token ends, in any script, and no special token holds such a place: no merge spans
#: the cut. (Numbers and other signs may join with what follows them.)
SAFE = regex.compile(r"(?<=\p{L})(?=[\s.,!?;:\u3001\u3002\uFF01\uFF0C\uFF1A\uFF1B\uFF1F\u060C\u061F\u0964])")


def pieces(text: str, most: int = PIECE) -> list[str]:
    """Cut ``text`` at safe places, each piece at least ``most`` characters but the last, and longer only as far as it must be."""
    out, start = [], 0
    while len(text) - start > most:
        found = SAFE.search(text, start + most)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


def batches_by_bytes(sizes: list[int], size: int = BATCH_BYTES) -> list[list[int]]:
    """Indexes of pieces of the given bytes packed into batches of about ``size`` bytes, long ones first."""
    out: list[list[int]] = []
    room = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if room <= 0:
            out.append([])
            room = size
        out[-1].append(i)
        room -= sizes[i] + 16
    return out


_held: dict[str, object] = {}


def _tokenizer(name: str):
    if name not in _held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(SparkFiles.get(name))
        t.no_truncation()
        t.no_padding()
        _held[name] = t
    return _held[name]


def counted(docs: DataFrame, vocabulary: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """Replace ``text`` by n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    Null texts count as empty (0 tokens). Special strings inside texts are what the library takes them for by default; none
    are added. Other columns pass through; any with a result's name is replaced.
    """
    added = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    docs = docs.drop(*[k for k, _ in added])
    schema = T.StructType([f for f in docs.schema.fields if f.name != text] + [T.StructField(k, t) for k, t in added])
    name = shipped(docs.sparkSession, vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(name)
        for rest, texts in blocks(rows, text, 8 << 20):
            parts, sizes, owner = [], [], []
            for i, t in enumerate(texts):
                cut = pieces(t.decode())
                parts += cut
                sizes += [len(t)] if len(cut) == 1 else [len(p.encode()) for p in cut]
                owner += [i] * len(cut)
            n = [0] * len(texts)
            for batch in batches_by_bytes(sizes):
                for i, e in zip(batch, tokenizer.encode_batch_fast([parts[i] for i in batch], add_special_tokens=False), strict=True):
                    n[owner[i]] += len(e)
            yield with_columns(rest, {"n_bytes": pa.array(list(map(len, texts)), pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n])})

    return docs.mapInArrow(tidy(run), schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
