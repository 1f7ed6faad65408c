"""Toxicity: held-out accuracy, the composed grammar, odd cases."""

from pyspark.sql import functions as F

from voltweave.llm import queries, toxicity as tx


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op3_toxicity_grammar"](spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic IS NOT NULL")
    rows = found.join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in rows}
    # A tenth of the size at which the lexicon is complete; some toxic labels there have no insult at all.
    assert share[1] > 0.75 and share[0] < 0.02


MODEL = tx.Model({"idiot": 4.0}, {"fools": 3.0}, 5.0, -4.0)


def weights(text):
    return tx.clause_weights(text, tx._Lexicon(MODEL), tx.compose())


def test_clauses_not_words_alone():
    assert weights("an idiot. fine") == [4.0]
    assert weights("you are an idiot.") == [4.0 * tx.TARGETED]
    assert weights("an idiot are you.") == [4.0 * tx.TARGETED]
    assert weights("you are not an idiot") == [4.0 * tx.TARGETED * tx.NEGATED]
    assert weights("she said idiot") == [4.0 * tx.TARGETED * tx.REPORTED]
    assert weights("not so. an idiot") == [4.0]
    assert weights("kill them!") == [tx.THREAT_WEIGHT * tx.TARGETED]
    assert weights("Foolsgold, IDIOT!! ok") == [3.0 + 4.0]
    assert weights("nothing here") == [] and weights("") == []


def test_odd_rows(docs_of, odd_texts):
    texts = [*odd_texts, "you idiot, " * 5000]
    got = {r.doc_id: r for r in tx.score(docs_of(texts, extra=True), MODEL, ["doc_id"]).collect()}
    low = 1 / (1 + 2.718281828459045 ** 4.0)
    assert all(abs(got[k].score - low) < 1e-9 and got[k].predicted == 0 for k in range(len(odd_texts)))
    assert got[len(odd_texts)].predicted == 1 and got[len(odd_texts)].score <= 1
    assert tx.score(docs_of(["a"]).limit(0), MODEL, ["doc_id"]).collect() == []


def test_labels_of_one_kind_or_none(docs_of):
    rows = docs_of(["a b", "c d", None])
    one_kind = rows.select("doc_id", F.lit(0).alias("label"))
    no_text = rows.select("doc_id", F.when(F.col("doc_id") == 2, 1).otherwise(0).alias("label"))
    for labels in (one_kind, one_kind.limit(0), no_text):
        model = tx.learn(rows, labels)
        assert [r.predicted for r in tx.score(docs_of(["a b"]), model, ["doc_id"]).collect()] == [0]
