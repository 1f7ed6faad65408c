"""The pipeline: every stage on what the one before kept."""

import corpus_pipeline as cp
from voltweave.llm import langid, simhash_dedup


def test_stages(spark, docs_of, odd_texts):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = docs
    counts = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == columns, name
        counts.append(kept.count())
    assert counts[0] >= counts[1] > 0.9 * counts[0] and counts[1] >= counts[2] == counts[3] == counts[4]
    named = simhash_dedup.near_duplicates(docs)
    assert {r.doc_id for r in kept.collect()} <= {r.component_id for r in named.collect()} | {r.doc_id for r in docs.collect()}
    final = cp.STAGES[-1][1](spark, kept, sf).collect()
    assert sorted(r.doc_id for r in final) == sorted(r.doc_id for r in kept.collect())
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, final))


def test_odd_rows_through_every_stage(spark, docs_of, odd_texts):
    docs = docs_of(odd_texts, extra=True)
    docs = docs.unionByName(docs)
    for rows in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, rows, "/none")
            assert out.columns == rows.columns and out.count() <= rows.count(), name
        assert cp.STAGES[-1][1](spark, rows, "/none").count() == rows.count()
    kept = {r.doc_id for r in cp.language(spark, docs, "/none").collect()}
    assert kept == {k for k, t in enumerate(odd_texts) if any(c.isalpha() for c in t or "")}
    assert langid.UNKNOWN == "und"
