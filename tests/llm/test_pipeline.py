"""The pipeline's stages, one after the other, on the smallest tables."""

import corpus_pipeline
from nivalis.llm.tables import read, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF))
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.5 * len(ids), name
        ids = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id", "shard", "slot").collect()
    assert {r.doc_id for r in last} == ids and len({(r.shard, r.slot) for r in last}) == len(last) == docs.count() and n >= len(ids)


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)) and "pipeline" in names
