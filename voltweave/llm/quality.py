"""Quality rules from repetition coverage.

Words are hashed in numpy by one polynomial pass over the bytes of many texts, word n-grams by a
rolling combination of those hashes. For several lengths n the characters that lie inside n-grams
found twice or more in the same text are counted, and those inside repeated lines. All hashes have 64
bits, and equal hashes within one text count as equal n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voltweave.llm.tables import slices, text_bytes

#: The space characters and symbols of the base rules.
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Word n-gram lengths and the largest share of word characters that may lie in repeated ones.
COVERAGE = {5: 0.20, 8: 0.18, 10: 0.16}
#: Largest share of word characters in repeated lines, and of symbols per word.
LINE_COVERAGE = 0.20
SYMBOLS_PER_WORD = 0.10
MIN_WORDS = 50

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the byte spans."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def repeated(keys: np.ndarray, later: bool = False) -> np.ndarray:
    """Which positions hold a value found twice or more (``later``: found before)."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    hit = np.zeros(len(keys), bool)
    hit[order[1:]] = same
    if not later:
        hit[order[:-1]] |= same
    return hit


def _spread(marks: np.ndarray, n: int) -> np.ndarray:
    """Positions covered by windows of length n that start at a mark."""
    out = marks.copy()
    for k in range(1, n):
        out[k:] |= marks[:-k]
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of the texts that lie end to end in ``data``."""
    n_docs = len(offsets) - 1
    space = _IS_SPACE[data]
    # A word starts at a non-space after a space or at the start of a text.
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    after = np.concatenate(([True], space[:-1])) if len(data) else space
    starts = np.flatnonzero(~space & (after | first[:-1]))
    before = np.concatenate((space[1:], [True])) if len(data) else space
    ends = np.flatnonzero(~space & (before | first[1:])) + 1
    points = (data & 0xC0) != 0x80
    upto = np.concatenate(([0], np.cumsum(points & ~space, dtype=np.int64)))
    word_bounds = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(n_docs), np.diff(word_bounds))
    chars = upto[ends] - upto[starts]
    out = {
        "n_words": np.diff(word_bounds), "word_chars": upto[offsets[1:]] - upto[offsets[:-1]],
        "n_symbols": _sums(_IS_SYMBOL[data], offsets),
    }
    own = span_hashes(data, starts, ends) + mix(doc.astype(np.uint64) + np.uint64(1))
    for n in (3, *COVERAGE):
        rolled = np.zeros(max(0, len(own) - n + 1), np.uint64)
        for k in range(n):
            rolled = rolled * np.uint64(_MULTIPLIER) + own[k: len(own) - n + 1 + k]
        inside = doc[: len(rolled)] == doc[n - 1:]
        places = np.flatnonzero(inside)
        marks = np.zeros(len(own), bool)
        marks[places] = repeated(mix(rolled[places]))
        covered = _spread(marks, n)
        if n == 3:
            out["n_repeat_words"] = _sums(covered, word_bounds)
        if n in COVERAGE:
            out[f"cover_{n}"] = _sums(np.where(covered, chars, 0), word_bounds)
    # Lines: cut at \n; those without a word don't count.
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate((offsets, breaks, breaks + 1)))
    line_starts, line_ends = cuts[:-1], cuts[1:]
    words_in = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    keep = words_in > 0
    line_starts, line_ends = line_starts[keep], line_ends[keep]
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    keys = span_hashes(data, line_starts, line_ends) + mix(line_doc.astype(np.uint64) + np.uint64(1))
    again = repeated(keys, later=True)
    bounds = np.searchsorted(line_doc, np.arange(n_docs + 1))
    out["n_dup_lines"] = _sums(again, bounds)
    out["cover_lines"] = _sums(np.where(again, upto[line_ends] - upto[line_starts], 0), bounds)
    return out


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          + "".join(f"cover_{n} long, " for n in COVERAGE) + "cover_lines long")


def repetition(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of measures per row of ``docs``.

    NULL and empty texts measure 0 throughout; texts of any length are read whole; repeated rows stay;
    other columns are left out; an empty table gives an empty result.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = measures(*text_bytes(part.column(text)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), *[pa.array(found[c].astype(np.int64)) for c in names]], [key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def verdict(measured: DataFrame) -> DataFrame:
    """The base rule, then the coverage rules: too many characters in repeated n-grams or lines, or symbols."""
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"
    fine = [f"cover_{n} <= {share} * word_chars" for n, share in COVERAGE.items()]
    fine += [f"cover_lines <= {LINE_COVERAGE} * word_chars", f"n_symbols <= {SYMBOLS_PER_WORD} * n_words"]
    return measured.selectExpr(
        "*", f"{failed} AS base_failed", f"NOT {failed} AND {' AND '.join(fine)} AS kept")
