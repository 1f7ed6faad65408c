"""Periodic runs of words by a suffix automaton with link-cut access.

The automaton of a word sequence is built word by word. Its suffix links form a tree in which the path
from a prefix's state to the root holds all suffixes of that prefix. Prefixes are then visited in order;
a visit recolours its path with its own end, by the access operation of a link-cut tree, so every state
knows where its strings ended last. A path comes apart into segments of one earlier end each, whose state
farthest from the root is as long as the two prefixes agree backwards. If the distance of the new end from the earlier one
lies among the lengths of the segment, a square of that period ends here, its root occurring at no smaller
distance, and the agreement says where the run of the period begins. Its last visit says where it ends.

A run of 12 words or more is covered by six-word windows that occur again within the run. Windows that
occur once are cut away first, by hashes, again and again until nothing more falls away; the automaton
reads what is left, whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.llm.tables import slices

#: Shortest run in words, and the words of a window: half of it, since a run repeats at half its length or less.
MIN_LENGTH = 12
WINDOW = MIN_LENGTH // 2


class Automaton:
    """Suffix automaton of a sequence of integers; ``ends[i]`` is the state of the prefix that ends at i."""

    def __init__(self, words: list[int]):
        self.length, self.link = array("i", [0]), array("i", [-1])
        # Most states have one way on, which stands in two arrays; further ones are in a dict.
        self._word, self._to = array("i", [-1]), array("i", [0])
        self._more: dict[int, dict[int, int]] = {}
        self.ends = array("i")
        for w in words:
            self._append(w)

    def _state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self._word.append(-1)
        self._to.append(0)
        return len(self.length) - 1

    def _next(self, state: int, word: int) -> int:
        if self._word[state] == word:
            return self._to[state]
        more = self._more.get(state)
        return more.get(word, -1) if more else -1

    def _lead(self, state: int, word: int, to: int) -> None:
        if self._word[state] in (-1, word):
            self._word[state], self._to[state] = word, to
        else:
            self._more.setdefault(state, {})[word] = to

    def _append(self, word: int) -> None:
        length, link = self.length, self.link
        last = self.ends[-1] if self.ends else 0
        new = self._state(length[last] + 1)
        p = last
        while p >= 0 and (q := self._next(p, word)) < 0:
            self._lead(p, word, new)
            p = link[p]
        if p >= 0:
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = self._state(length[p] + 1)
                self._word[copy], self._to[copy], link[copy] = self._word[q], self._to[q], link[q]
                if q in self._more:
                    self._more[copy] = dict(self._more[q])
                while p >= 0 and self._next(p, word) == q:
                    self._lead(p, word, copy)
                    p = link[p]
                link[q] = link[new] = copy
        self.ends.append(new)


class LastEnds:
    """The last end of every state of a tree of suffix links, kept by preferred paths of one colour.

    A preferred path is a splay tree ordered by depth; the colour stands at its root.
    """

    def __init__(self, link: array):
        self.up = array("i", link)
        self.left, self.right, self.colour = (array("i", [-1]) * len(link) for _ in range(3))

    def _rotate(self, x: int, y: int) -> None:
        up, left, right = self.up, self.left, self.right
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b >= 0:
            up[b] = y
        up[y], up[x] = x, z
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
            else:
                self.colour[x] = self.colour[y]
        else:
            self.colour[x] = self.colour[y]

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while (y := up[x]) >= 0 and (left[y] == x or right[y] == x):
            z = up[y]
            if z >= 0 and (left[z] == y or right[z] == y):
                if (left[z] == y) == (left[y] == x):
                    self._rotate(y, z)
                else:
                    self._rotate(x, y)
                    self._rotate(x, z)
                    continue
            self._rotate(x, y)

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Recolour the path from a state to the root; its segments before that, from the state on: the
        state of each that is farthest from the root, and the colour."""
        up, right, colour = self.up, self.right, self.colour
        segments, deeper, x = [], -1, state
        while x >= 0:
            self._splay(x)
            segments.append((x, colour[x]))
            if (rest := right[x]) >= 0:
                colour[rest] = colour[x]  # what lies below leaves with its colour
            right[x] = deeper
            deeper, x = x, up[x]
        colour[deeper] = end
        return segments


def runs_of(words: list[int], least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period."""
    machine = Automaton(words)
    tree, length = LastEnds(machine.link), machine.length
    found: dict[tuple[int, int], int] = {}
    for end, state in enumerate(machine.ends):
        below = 0
        for deepest, before in reversed(tree.access(state, end)):
            agree = length[deepest]
            if before >= 0 and below < end - before <= agree:
                found[before - agree + 1, end - before] = end
            below = agree
    return sorted((start, end - start + 1, period) for (start, period), end in found.items() if end - start + 1 >= least)


def stretches(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Bounds (rows of start and stop) of the stretches of one owner in which every word lies in a window that
    the stretch has again; ``words`` are hashes, so equal ones only add to a stretch."""
    n = len(words)
    if n < WINDOW:
        return np.zeros((0, 2), np.int64)
    window = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + words[k: n - WINDOW + 1 + k]
    window ^= window >> np.uint64(29)
    group, left = owner.astype(np.int64), None
    at = np.flatnonzero(owner[: n - WINDOW + 1] == owner[WINDOW - 1:])
    while True:
        # Windows of one stretch that stand there again.
        key = window[at] + group[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        at = at[again]
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + WINDOW, -1)
        covered = np.cumsum(marks[:-1]) > 0
        # A stretch ends where nothing covers or another owner begins.
        fresh = covered.copy()
        fresh[1:] &= ~covered[:-1] | (owner[1:] != owner[:-1])
        group = np.cumsum(fresh)
        if left is not None and len(at) == left:
            break
        left = len(at)
    starts = np.flatnonzero(fresh)
    stop = covered.copy()
    stop[:-1] &= ~covered[1:] | (owner[1:] != owner[:-1])
    return np.stack([starts, np.flatnonzero(stop) + 1], axis=1)


def of_texts(texts: list[bytes | None]) -> list[tuple[list[tuple[int, int, int]], str, int]]:
    """For every text its runs, the words outside of repeated periods joined by spaces, and the number of words."""
    split = [(t or b"").split() for t in texts]
    sizes = [len(s) for s in split]
    total = sum(sizes)
    hashed = np.fromiter(map(hash, chain.from_iterable(split)), np.int64, total).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, stop in stretches(hashed, owner).tolist():
        doc = int(owner[start])
        first = start - int(offsets[doc])
        names: dict[bytes, int] = {}
        words = [names.setdefault(w, len(names)) for w in split[doc][first: first + stop - start]]
        found[doc] += [(first + s, n, p) for s, n, p in runs_of(words)]
    out = []
    for words, runs in zip(split, found):
        if runs:
            kept, at = [], 0
            # The repeats of runs, merged where they overlap.
            for begin, end in sorted((s + p, s + n) for s, n, p in runs):
                kept += words[at: max(at, begin)]
                at = max(at, end)
            kept += words[at:]
        else:
            kept = words
        out.append((runs, b" ".join(kept).decode(), len(words)))
    return out


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, runs, collapsed`` of every whole text.

    Words are separated by ASCII white space. A run is a stretch of at least 12 words that is at least twice
    its smallest period long and can't be extended; ``runs`` are ordered by start, then period; ``collapsed``
    are the words without the repeats (all but the first period of every run), joined by one space. A NULL or empty
    text has no words, no runs and an empty collapsed text. Repeated rows and NULL keys stay; other columns
    are left out; an empty table gives an empty result. Memory: about 150 bytes for each word of the longest
    stretch of repeating words, besides the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                done = of_texts(part.column(text).cast(pa.binary()).to_pylist())
                runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r, _, _ in done]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array([n for _, _, n in done], pa.int64()), pa.array(runs, kind),
                     pa.array([c for _, c, _ in done], pa.string())], [key, "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words bigint, runs array<{RUN}>, collapsed string")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of runs, the greatest one (ties: smallest start, then period) and hashes of runs and collapsed text."""
    ranked = F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("_best", F.array_max(ranked))
    start, length, period = -F.col("_best.before"), F.col("_best.length"), -F.col("_best.shorter")
    return best.select(
        key, F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * _best.length div -_best.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in one document of ten (by the crc32 of its id) the words from a fixed place on become
    copies of the next few; the other texts, and those without an id, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", h.alias("_h")).withColumn("_words", F.when(
        F.col("_h") % 10 == 0, F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")))
    chosen = chosen.withColumn("_n", F.size("_words")).withColumn("_a", F.expr("cast((_h div 10) % _n as int)"))
    chosen = chosen.withColumn("_p", F.expr("1 + cast((_n - _a) div (3 + (_h div 10) % 8) as int)"))
    head, block = F.slice("_words", F.lit(1), F.col("_a")), F.slice("_words", F.col("_a") + 1, F.col("_p"))
    rest = F.col("_n") - F.col("_a")
    tail = F.slice(F.flatten(F.array_repeat(block, F.expr("cast((_n - _a + _p - 1) div _p as int)"))), F.lit(1), rest)
    # A text without a word splits into one empty word, which stays one.
    return chosen.select("doc_id", F.when(
        F.col("_words").isNotNull(), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))
