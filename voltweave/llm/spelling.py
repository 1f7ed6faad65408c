"""Spelling variants: words one edit apart, grouped under the most frequent of them.

Words are counted over all documents. The vocabulary is cut into blocks of words that follow each other
in order, once by their beginnings and once by their ends; each block is a bidirectional FM-index in one
task (``fmindex``). A word is sent to the blocks that hold words beginning with its first half, and to those that hold
words ending with its second half: an edit leaves one half as it is. So neither the vocabulary nor the
words of one beginning come together, and every block reads the words sent to it batch by batch.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.llm.fmindex import Index
from voltweave.llm.tables import slices
from voltweave.runtime import cut

#: Letters, as UTF-8: A-Z, a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
#: For texts of ASCII: letters in lower case, all else a space.
_PLAIN = bytes([c | 32 if 65 <= (c & 0xDF) <= 90 else 32 for c in range(256)])
MIN_CHARS, MIN_TIMES = 6, 5
#: A form is so many times as frequent as the word.
RATIO = 5
#: One run of a document in so many loses a letter.
DELETED = 199
#: Words of an index, words searched at once (and their letters), and words counted by a worker before they are handed on.
BLOCK, BATCH, BATCH_CHARS, HELD = 10_000, 8192, 2_000_000, 200_000


def runs_in(text: bytes) -> list[bytes]:
    """Maximal runs of letters, A-Z in lower case."""
    return text.translate(_PLAIN).split() if text.isascii() else [r.lower() for r in RUN.findall(text)]


def damaged(run: bytes, seed: int, every: int | None) -> str:
    """The run, without one letter if ``every`` divides the hash of id and run; ``seed`` is the hash of ``<id>:``."""
    word = run.decode()
    if every:
        h = crc32(run, seed)
        if h % every == 0:
            at = h % len(word)
            return word[:at] + word[at + 1:]
    return word


def counts(docs: DataFrame, every: int | None = DELETED) -> DataFrame:
    """``word, n``: words of at least ``MIN_CHARS`` letters and how often they occur over all documents.

    With ``every`` one run of a document in so many loses a letter first (never in documents without an id).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    seed, some = crc32(f"{doc}:".encode()), every if doc is not None else None
                    for word, n in Counter(runs_in(text or b"")).items():
                        # A letter has two bytes at most.
                        if len(word) >= MIN_CHARS:
                            held[damaged(word, seed, some)] += n
                if len(held) > HELD:
                    yield handed(held)
                    held = Counter()
        yield handed(held)

    def handed(held: Counter[str]) -> pa.RecordBatch:
        words = [w for w in held if len(w) >= MIN_CHARS]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _blocks(words: DataFrame, size: int, tail: bool) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """``word, n, block`` by ranges of the words (with ``tail``: read backwards), written; and the first and last
    word of each block in use with its number, one entry in ``size`` words."""
    order = F.reverse("word") if tail else F.col("word")
    n = max(1, -(-words.count() // size))
    dealt = words.withColumn("_by", order).repartitionByRange(n, "_by").withColumn("block", F.spark_partition_id())
    dealt = cut(dealt)
    bounds = dealt.groupBy("block").agg(F.min("_by").alias("low"), F.max("_by").alias("high"))
    return dealt.drop("_by"), sorted((r.low, r.high, r.block) for r in bounds.collect())


def _sent(words: DataFrame, bounds: list[tuple[str, str, int]], tail: bool) -> DataFrame:
    """``block, word``: a row for every block that may hold words with this half of the word."""
    lows, highs, numbers = ([b[k] for b in bounds] for k in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, sent = [], []
            for word in batch.column("word").to_pylist():
                h = len(word) // 2
                half = word[::-1][: len(word) - h] if tail else word[:h]
                for k in range(bisect_left(highs, half), bisect_right(lows, half + "\U0010ffff")):
                    blocks.append(numbers[k])
                    sent.append(word)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(sent, pa.string())], ["block", "word"])

    return words.select("word").mapInArrow(run, "block int, word string")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, near_n, near`` for every word with a near one: how many there are, and the most frequent
    of them (ties: the smallest in code-point order). ``words`` are different, with their number ``n``."""
    parts = [_searched(words, block, tail) for tail in (False, True)]
    best = F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("_best")
    both = parts[0].unionByName(parts[1]).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return both.select("word", "n_near", (-F.col("_best.least")).alias("near_n"), F.col("_best.near").alias("near"))


def _searched(words: DataFrame, size: int, tail: bool) -> DataFrame:
    blocks, bounds = _blocks(words, size, tail)
    sent = _sent(words, bounds, tail)
    rows = blocks.select("block", "n", "word").unionByName(sent.select("block", F.lit(None).cast("long").alias("n"), "word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of a block (with n), then those sent to it."""
        now, index, built = None, {}, None
        for batch in batches:
            for number, n, word in _pieces(batch):
                if number != now:
                    now, index, built = number, {}, None
                own = np.flatnonzero(n >= 0)
                index.update(zip(word[own].tolist(), n[own].tolist()))
                asked = word[n < 0].tolist()
                if asked and index:
                    built = built or _Block(index)
                    for part in _by_length(asked):
                        yield from built.answers(part, tail)

    sorted_rows = rows.repartition("block").sortWithinPartitions("block", F.col("n").isNull())
    return sorted_rows.mapInArrow(run, "word string, n_near bigint, near_n bigint, near string")


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The parts of a batch of one block each: its number, the counts (-1 for words sent) and the words."""
    if batch.num_rows == 0:
        return
    number = batch.column("block").to_numpy()
    n = batch.column("n").fill_null(-1).to_numpy()
    word = np.array(batch.column("word").to_pylist(), object)
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(number[a]), n[a:b], word[a:b]


def _by_length(words: list[str]) -> Iterator[list[str]]:
    """Words of one length, not too many letters at once."""
    grouped: dict[int, list[str]] = {}
    for w in words:
        grouped.setdefault(len(w), []).append(w)
    for length, group in grouped.items():
        step = max(1, min(BATCH, BATCH_CHARS // length))
        for k in range(0, len(group), step):
            yield group[k: k + step]


class _Block:
    def __init__(self, counted: dict[str, int]):
        words = sorted(counted)
        self.index = Index(words)
        self.n = np.array([counted[w] for w in words], np.int64)

    def answers(self, words: list[str], tail: bool) -> Iterator[pa.RecordBatch]:
        """Near words with the same half: number and most frequent one of each word that has any."""
        half = len(words[0]) // 2
        rows, ranks = self.index.near(words, half, tail)
        if tail:  # those with the same first half as well are found by it
            apart = np.array([words[r][:half] != self.index.words[k][:half] for r, k in zip(rows.tolist(), ranks.tolist())], bool)
            rows, ranks = rows[apart], ranks[apart]
        if not len(rows):
            return
        order = np.lexsort((ranks, -self.n[ranks], rows))
        rows, ranks = rows[order], ranks[order]
        first = np.flatnonzero(np.concatenate(([True], np.diff(rows) != 0)))
        sizes = np.diff(np.append(first, len(rows)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[r] for r in rows[first].tolist()], pa.string()), pa.array(sizes, pa.int64()),
             pa.array(self.n[ranks[first]], pa.int64()), pa.array([self.index.words[k] for k in ranks[first].tolist()], pa.string())],
            ["word", "n_near", "near_n", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word with a form (columns word, form): the end of its chain of forms.

    A form is at least ``RATIO`` times as frequent, so a chain has no more than 27 links. Each round doubles what is followed.
    """
    way = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(5):
        ahead = way.select(F.col("word").alias("_at"), F.col("root").alias("_ahead"))
        longer = way.join(ahead, F.col("root") == F.col("_at"), "left")
        moved = cut(longer.select("word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("_moved")))
        way = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            break
    return way


def variants(docs: DataFrame, every: int | None = DELETED, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least 6 letters that occurs at least 5 times.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; ``n_near`` is the number
    of words that differ by one inserted, deleted or replaced letter. The form is the most frequent
    near word (ties: the smallest) if it is at least 5 times as frequent, else NULL; the root is where
    following forms ends. ``every``: see ``counts``. NULL and empty texts have no words; repeated rows count each time; documents without
    an id count undamaged; other columns are left out; an empty table gives an empty result.
    """
    words = cut(counts(docs, every).where(F.col("n") >= MIN_TIMES))
    found = words.join(near_words(words, block), "word", "left")
    is_form = F.col("near_n") >= RATIO * F.col("n")
    found = cut(found.select(
        "word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("near_n")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
