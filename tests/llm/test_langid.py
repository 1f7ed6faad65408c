"""Language ID: held-out accuracy and odd cases."""

from pyspark.sql import functions as F

from voltweave.llm import langid, queries


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.where("held_out").join(docs.where("lang IS NOT NULL"), "doc_id").agg(F.avg(F.expr("double(lang = lang_pred)"))).first()[0]
    assert right > 0.97


def test_odd_rows(docs_of, odd_texts):
    train = docs_of(["the cat sat on the mat", "der hund und die katze"]).withColumn(
        "lang", F.when(F.col("doc_id") == 0, "en").otherwise("de"))
    model = langid.train(train)
    got = {r.doc_id: r for r in langid.predict(docs_of([*odd_texts, "the mat", "und der 🐕"], extra=True), model).collect()}
    assert len(got) == len(odd_texts) + 2 and got[len(odd_texts)].lang_pred == "en" and got[len(odd_texts) + 1].lang_pred == "de"
    for k, t in enumerate(odd_texts):
        assert (got[k].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[k].score <= 1
        assert got[k].block == 1


def test_no_labels_and_no_rows(docs_of):
    model = langid.train(docs_of(["a"]).withColumn("lang", F.lit(None).cast("string")))
    assert [r.lang_pred for r in langid.predict(docs_of(["hello"]), model).collect()] == ["und"]
    assert langid.predict(docs_of(["a"]).limit(0), model).collect() == []
