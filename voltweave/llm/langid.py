"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-gram buckets per language on a bounded sample of labelled documents and keeps the
log-probabilities as one matrix (buckets x languages), which is broadcast. Scoring hashes all n-grams
of many texts at once in numpy, gathers their rows of the matrix and sums them per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from voltweave.llm.tables import row_hash, slices, text_bytes

BUCKETS = 1 << 15
ORDERS = (2, 3)
#: Documents per language that the model is fitted on at most.
SAMPLE_PER_LANGUAGE = 3000
#: Languages (distinct labels) that a model may have.
MAX_LANGUAGES = 500
UNKNOWN = "und"
SMOOTHING = 0.5


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS x orders, languages), float32
    prior: np.ndarray


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the offsets of the texts among them."""
    lead = (data & 0xC0) != 0x80
    count = np.concatenate(([0], np.cumsum(lead, dtype=np.int64)))
    if len(data) and data.max() < 128:
        return data.astype(np.uint32), offsets
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, count[offsets]


def _fold() -> np.ndarray:
    """Lower case of the basic plane; 0 stands for everything that is no letter."""
    out = np.zeros(0x10000, np.uint16)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLDED: list[np.ndarray] = []


def folded(points: np.ndarray) -> np.ndarray:
    """Lower-cased letters; every run of other characters counts as a border (0). Letters beyond the
    basic plane fold to one value per block of 256."""
    if not _FOLDED:
        _FOLDED.append(_fold())
    out = _FOLDED[0][np.minimum(points, 0xFFFF)]
    beyond = points > 0xFFFF
    if beyond.any():
        blocks = np.array([chr(p).isalpha() for p in points[beyond]]) * (0xE000 + (points[beyond] >> 8) % 4096)
        out[beyond] = blocks
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram with a letter, and the letters per text.

    An n-gram spans letters and at most one border at either end; borders inside it are skipped.
    """
    points, at = _code_points(data, offsets)
    n_docs = len(offsets) - 1
    f = folded(points)
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(at))
    letters = np.bincount(doc[f > 0], minlength=n_docs)
    # One border between words and between texts.
    keep = np.ones(len(f), bool)
    if len(f):
        keep[1:] = (f[1:] > 0) | (f[:-1] > 0) | (doc[1:] != doc[:-1])
    f, doc = f[keep].astype(np.uint32), doc[keep]
    found, owner = [], []
    for k, n in enumerate(ORDERS):
        m = len(f) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) + f[j: m + j]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        good = doc[:m] == doc[n - 1:]
        for j in range(1, n - 1):
            good &= f[j: m + j] > 0
        good &= (f[:m] > 0) | (f[n - 1:] > 0)
        found.append((h[good] >> np.uint32(17)).astype(np.int64) + k * BUCKETS)
        owner.append(doc[:m][good])
    empty = np.zeros(0, np.int64)
    return np.concatenate(found or [empty]), np.concatenate(owner or [empty]), letters


def sample(docs: DataFrame, label: str, per_label: int) -> tuple[DataFrame, list]:
    """About ``per_label`` rows of every label at most, chosen by a hash of the row, and the labels.

    The hash covers all columns, so that a group of copies with different ids counts by its size. Only
    one count per label reaches the driver.
    """
    counts = {r[0]: r[1] for r in docs.groupBy(label).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(int(min(1.0, per_label / n) * 1_000_000))).otherwise(share)
    return docs.where(F.pmod(row_hash(docs, "sample"), F.lit(1_000_000)) < share), sorted(counts)


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on rows with text and ``lang``; a table without such rows gives a model without languages."""
    picked, languages = sample(docs.where("text IS NOT NULL AND lang IS NOT NULL"), "lang", per_language)
    picked = picked.select("text", "lang")
    index = {lang: k for k, lang in enumerate(languages)}
    width = BUCKETS * len(ORDERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(index), width), np.int64)
        for batch in batches:
            for part in slices(batch):
                bucket, owner, _ = grams(*text_bytes(part.column("text")))
                code = np.array([index[x] for x in part.column("lang").to_pylist()], np.int64)
                total += np.bincount(code[owner] * width + bucket, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    counts = picked.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    totals = np.zeros((width, len(languages)))
    table = counts.toArrow()  # at most buckets x languages rows
    totals[table["bucket"].to_numpy(), table["lang"].to_numpy()] = table["n"].to_numpy()
    smooth = totals + SMOOTHING
    weights = np.concatenate([np.log(w / w.sum(axis=0)) for w in np.split(smooth, len(ORDERS))]).astype(np.float32)
    # Even priors: the sample says nothing of how frequent a language is.
    return Model(languages, weights, np.zeros(len(languages)))


def classify(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language index (-1: none) and its posterior for texts that lie end to end."""
    bucket, owner, letters = grams(data, offsets)
    n_docs = len(offsets) - 1
    if not model.languages:
        return np.full(n_docs, -1), np.zeros(n_docs)
    # Summed language by language, so that memory doesn't grow with their number.
    logs = np.stack([
        np.bincount(owner, weights=model.weights[:, k][bucket], minlength=n_docs) + model.prior[k]
        for k in range(len(model.languages))], axis=1)
    best = logs.argmax(axis=1)
    score = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    none = letters == 0
    return np.where(none, -1, best), np.where(none, 0.0, score)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Every column of ``docs`` with prediction and score under ``names`` (columns of those names are replaced).

    NULL texts and texts without a letter are ``und`` with score 0, as is everything under a model
    without languages. Ties go to the first language in alphabetical order; repeated rows stay; an empty
    table stays empty.
    """
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        values = pa.array([*m.languages, UNKNOWN])
        for batch in batches:
            for part in slices(batch):
                best, score = classify(m, *text_bytes(part.column("text")))
                pred = pc.take(values, pa.array(np.where(best < 0, len(m.languages), best)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pred, pa.array(score, pa.float64())], [*part.schema.names, *names])

    return docs.mapInArrow(run, StructType([
        *docs.schema, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))
