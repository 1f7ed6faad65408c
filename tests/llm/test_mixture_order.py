"""The mixture's order through written files."""

import corpus_pipeline as cp
from voltweave.llm import mixing as mx


def test_tokens_carry_the_place_in_the_mixture(spark, docs_of, tmp_path):
    # Short texts first by source, so that later files are larger and a scan deals them out in another order.
    docs = docs_of([f"text {k} " * (1 + k % 90) for k in range(1500)], source=lambda k: "a" if k % 90 < 30 else "b" if k % 7 else "c")
    want = [r.doc_id for r in sorted(mx.mix(docs).collect(), key=lambda r: (r.slot, r.place))]
    path = str(tmp_path / "mixture")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cp.mixture(spark, docs, "/none").write.parquet(path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "mixture").glob("part-*.parquet"))) > 3
    rows = cp.tokens(spark, spark.read.parquet(path), "/none").collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.position)] == want
    assert sorted(r.position for r in rows) == list(range(1500))
