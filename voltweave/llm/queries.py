"""Registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.llm import bpe, chat, fingerprints, langid, mixing, pieces, pii, quality, runs, simhash_dedup, spelling, toxicity, warc
from voltweave.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def fold(n: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into one part of n; a NULL id doesn't."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == part, F.lit(False))


@_register("op1_chat_role_repair")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


@_register("op2_bpe_round_trip")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path(bpe.TOKENIZER)))


@_register("op3_toxicity_grammar")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fold(3, 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~fold(3, 1)).where("toxic IS NOT NULL")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model, ["doc_id", "held_out"])


@_register("op4_pii_semi_markov")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.model(docs))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


@_register("op5_pfair_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


@_register("op6_warc_bundles", """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (
      SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS last FROM p)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
      CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
    FROM q""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_register("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold(4, 2).alias("held_out"))
    model = langid.train(docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


@_register("op8_simhash_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@_register("op9_repetition_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdict(quality.repetition(table(spark, sf_dir, "documents")))


@_register("op10_simhash_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_register("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find(runs.planted(table(spark, sf_dir, "documents"))))


@_register("op12_sentencepiece_agenda")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pieces.digests(pieces.encode_decode(docs, public_tokenizers.path(pieces.MODEL)))


@_register("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
