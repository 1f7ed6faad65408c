"""The corpus pipeline: documents to token counts, each stage written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.llm import bpe, jaccard, langid, mixing, pii
from voltweave.llm.tables import file_order, positions, table
from voltweave.runtime import cut, local_default

#: Documents whose language is less certain than this go, as do those without a letter.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents in a language that the model knows stay as they are.

    The model is fitted on the labelled documents of the stage's own input.
    """
    local_default(spark)
    found = ("_vw_language", "_vw_score")
    kept = langid.predict(docs, langid.train(docs), found)
    kept = kept.where((F.col(found[0]) != langid.UNKNOWN) & (F.col(found[1]) >= MIN_LANGUAGE_SCORE))
    return kept.drop(*found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8 with five-word shingles: one document of each group of texts at least 0.8 alike stays."""
    local_default(spark)
    return jaccard.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: spans of personal data are masked; n_chars follows the new text."""
    local_default(spark)
    names = docs.columns
    masked = pii.mask(docs, pii.model(docs))
    changed = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return masked.withColumn("n_chars", changed).select(*[F.col(f"`{c}`") for c in names])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the rows in the order of the mixture, which file numbers and rows within files keep."""
    local_default(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token count and digests of each document, and ``position``, its place in the mixture."""
    local_default(spark)
    at = ("_vw_file", "_vw_at")
    docs = file_order(docs, *at)
    coded = bpe.encode_decode(
        docs.select(F.struct("doc_id", *at).alias("_vw_key"), "text"), public_tokenizers.path(bpe.TOKENIZER), "_vw_key")
    return positions(bpe.digests(coded, "_vw_key").select("_vw_key.*", "*").drop("_vw_key"), docs.groupBy(at[0]).count(), *at)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
    ("mixture", mixture), ("tokens", tokens),
]
#: Models, fingerprints of XXH64 and a tokenizer: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    local_default(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
