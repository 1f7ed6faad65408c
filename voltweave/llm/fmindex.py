"""Bidirectional FM-index over a vocabulary of delimited words, searched for many words at once.

The words stand in one cyclic text, each followed by the delimiter, and so does the text backwards. A
pattern is held by its interval of suffix ranks in either; a character before it narrows the interval of
the forward text by ranks in its Burrows-Wheeler transform and shifts the other one by the number
of smaller characters, and a character behind it the other way round. Ranks are bit counts: one bit vector per
character with sums every 64 positions.

The search scheme for one error matches one half of a word and the delimiter beside it exactly and extends across the
other half, allowing the error there; the mirrored scheme does the same from the other half. A pattern with both
delimiters is a row of the delimiter's own interval, and its rank there is the rank of the word.
"""

from __future__ import annotations

import numpy as np

#: Code of the delimiter; smaller than all letters.
MARK = 0
#: Cells (words x letters) whose ranks are looked up at once.
CELLS = 4_000_000


def rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of a text in order, by doubling the compared length."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        key = rank * n + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (np.diff(key[order]) != 0).astype(np.int64))))
        width *= 2
        if rank[order[-1]] == n - 1 or width >= n:
            return order


class Ranks:
    """How often each character, and any smaller one, stands in the first i places of a transform."""

    def __init__(self, text: np.ndarray, letters: int):
        last = text[rotations(text) - 1]
        n = len(last)
        self.size, self.letters = n, letters
        self.first = np.concatenate(([0], np.cumsum(np.bincount(last, minlength=letters))))[:-1]
        words = n // 64 + 1
        self._bits = np.zeros((letters, words), np.uint64)
        for c in range(letters):
            packed = np.zeros(words * 8, np.uint8)
            own = np.packbits(last == c, bitorder="little")
            packed[: len(own)] = own
            self._bits[c] = packed.view("<u8")
        counts = np.bitwise_count(self._bits).astype(np.int32)
        self._sums = np.cumsum(counts, axis=1, dtype=np.int32) - counts
        # The same for all smaller characters: their bits never overlap.
        self._less = np.zeros_like(self._bits)
        np.bitwise_or.accumulate(self._bits[:-1], axis=0, out=self._less[1:])
        counts = np.bitwise_count(self._less).astype(np.int32)
        self._less_sums = np.cumsum(counts, axis=1, dtype=np.int32) - counts

    def _count(self, bits: np.ndarray, sums: np.ndarray, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return sums[c, word] + np.bitwise_count(bits[c, word] & mask)

    def extend(self, own: np.ndarray, other: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """Interval starts in this index and in the other one, and sizes, with the character added on this side."""
        low = self._count(self._bits, self._sums, c, own)
        new = self._count(self._bits, self._sums, c, own + size) - low
        smaller = self._count(self._less, self._less_sums, c, own + size) - self._count(self._less, self._less_sums, c, own)
        return self.first[c] + low, other + smaller, new


class Index:
    """The two rank tables of a list of different words in code-point order."""

    def __init__(self, words: list[str]):
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(chars)
        self.words = words
        ends = np.cumsum([len(w) for w in words])
        text = np.insert(np.searchsorted(self.alphabet, chars) + 1, ends, MARK)
        letters = len(self.alphabet) + 1
        self.left, self.right = Ranks(text, letters), Ranks(text[::-1], letters)

    def codes(self, words: list[str]) -> np.ndarray:
        """Words of one length as rows of codes; letters that the index doesn't have are -1."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == chars, at + 1, -1)

    def near(self, words: list[str], half: int, tail: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``words``, rank of an indexed word) that differ by one insertion, deletion or replacement.

        All words have one length. Their first ``half`` letters are equal; with ``tail`` those behind are.
        Every pair comes once.
        """
        codes = self.codes(words)
        if not tail:
            return _search(self.left, self.right, codes, half)[:2]
        rows, _, ranks = _search(self.right, self.left, codes[:, ::-1], codes.shape[1] - half)
        return rows, ranks


def _search(inward: Ranks, outward: Ranks, codes: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and their ranks in the index of ``inward`` and of ``outward``.

    The first ``half`` codes are matched exactly towards the delimiter before them, through ``inward``;
    the others from there on, through ``outward``.
    """
    m = codes.shape[1]
    rows = np.flatnonzero((codes[:, :half] >= 0).all(axis=1))
    a, b, size = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), inward.size)
    for j in range(half - 1, -2, -1):
        c = codes[rows, j] if j >= 0 else np.full(len(rows), MARK)
        a, b, size = inward.extend(a, b, size, c)
        rows, a, b, size = _alive(size, rows, a, b)
    exact, erring = (rows, a, b, size), []
    for j in range(half, m + 1):
        now, behind = erring, []
        rows, a, b, size = exact
        if len(rows):
            due = codes[rows, j] if j < m else np.full(len(rows), -1)
            for part in np.array_split(np.arange(len(rows)), len(rows) * inward.letters // CELLS + 1):
                which = np.repeat(part, inward.letters - 1)
                c = np.tile(np.arange(1, inward.letters), len(part))
                other = c != due[which]
                which, c = which[other], c[other]
                grown = outward.extend(b[which], a[which], size[which], c)
                state = _alive(grown[2], rows[which], grown[1], grown[0])
                # An inserted letter equal to the next one is one inserted behind it.
                now = [*now, state]
                if j < m:
                    behind.append(state)
            if j < m:
                # Of equal neighbours the last one is left out.
                last = np.ones(len(rows), bool) if j == m - 1 else due != codes[rows, j + 1]
                behind.append((rows[last], a[last], b[last], size[last]))
                exact = _step(outward, exact, due)
        if now:
            now = tuple(np.concatenate(x) for x in zip(*now))
            due = codes[now[0], j] if j < m else np.full(len(now[0]), MARK)
            behind.append(_step(outward, now, due))
        erring = behind
    if not erring:
        return (np.zeros(0, np.int64),) * 3
    rows, a, b, _ = (np.concatenate(x) for x in zip(*erring))
    return rows, a, b


def _step(outward: Ranks, state: tuple[np.ndarray, ...], due: np.ndarray) -> tuple[np.ndarray, ...]:
    rows, a, b, size = (x[due >= 0] for x in state)
    b, a, size = outward.extend(b, a, size, due[due >= 0])
    return _alive(size, rows, a, b)


def _alive(size: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    keep = size > 0
    return rows[keep], a[keep], b[keep], size[keep]
