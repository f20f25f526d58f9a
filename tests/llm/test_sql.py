import pytest
from oracle import duck, same

import corpus_pipeline
from tracemill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE[name], duck(SF))


def test_all_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        left = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids
        docs, ids = out, set(left)
    done = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    import hashlib

    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in done} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in done}
