"""Byte-pair encoding by a tokenization automaton.

``compile_merges`` starts from the universal automaton over the base symbols (one state, a loop per
symbol) and adds one gadget per merge, in order. The gadget of ``(u, v) -> w`` lets ``u`` lead to a
new state, a copy of its old one without the arc ``v``, and gives every state with a path ``u v``
an arc ``w`` to where that path ended. The automaton then accepts exactly the right token sequences:
a word has one accepted path, and its arc labels are the tokens.

All arcs of one label lead to one state, so a state is named by the label that leads to it, and a row
of the table is what that state lacks: its own removals, then those its ancestors had when it was
copied. The compiled table therefore has one entry per merge and not states x tokens cells.
``Automaton.tokens`` walks a word from left to right; which arcs are spelled where comes from one pass of a
string-matching table over the vocabulary.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.llm.tables import slices, string_list

TOKENIZER = "word_bpe_49k.json"
#: Stands for the word end in spellings; no byte symbol.
END = "\x01"
#: Words and chunks remembered by a worker; above it the memory is emptied and filled anew.
MEMORY = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in table]
    table.update({b: chr(256 + k) for k, b in enumerate(hidden)})
    return [table[b] for b in range(256)]


class Automaton:
    """The compiled states and the arcs of a merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values()) + 1
        #: Of a merged token: the label its arcs stand beside, the label whose state it leads to, and when.
        self.left, self.right, self.born = [-1] * size, [-1] * size, [0] * size
        #: (label, token) -> when the state behind the label lost its arc for the token.
        self.removed: dict[int, int] = {}
        for time, (u, v) in enumerate(merges, 1):
            self._gadget(vocab[u], vocab[v], vocab[u + v], time)
        self._known: dict[int, bool] = {}
        #: All arcs by their spelling; a word end is one more character.
        self.arcs = ahocorasick.Automaton()
        for token, ident in vocab.items():
            spelled = _spelled(token)
            if self.left[ident] >= 0 or len(spelled.rstrip(END)) == 1:
                self.arcs.add_word(spelled, ident << 20 | len(spelled))
        self.arcs.make_automaton()

    def _gadget(self, u: int, v: int, w: int, time: int) -> None:
        if not self._arc(u, v):
            return  # no path u v is left: the merge never applies
        self.left[w], self.right[w], self.born[w] = u, v, time
        self.removed[u << 20 | v] = time

    def _lost(self, label: int, token: int) -> int | None:
        """When the state behind a label, or the one it was copied from, lost the arc."""
        limit = 1 << 60
        while label >= 0:
            when = self.removed.get(label << 20 | token)
            if when is not None and when < limit:
                return when
            limit, label = self.born[label], self.right[label]
        return None

    def _arc(self, label: int, token: int) -> bool:
        """A token may follow unless its arc was removed, or was never added since its first part had none."""
        limit = 1 << 60
        while token >= 0:
            when = self._lost(label, token)
            if when is not None and when <= limit:
                return False
            limit, token = self.born[token], self.left[token]
        return True

    def arc(self, label: int, token: int) -> bool:
        """The same, remembered in the transition table."""
        key = label << 20 | token
        known = self._known.get(key)
        if known is None:
            if len(self._known) > MEMORY:
                self._known.clear()
            known = self._known[key] = label < 0 or self._arc(label, token)
        return known

    def tokens(self, word: str) -> list[int]:
        """Labels of the accepted path over a word spelled by ``byte_symbols`` and the end mark.

        The way to each position is unique, so the first arc that may enter it is the right one.
        """
        n, known, arc = len(word), self._known, self.arc
        label, start = [None] * (n + 1), [0] * (n + 1)
        label[0] = -1
        for end, found in self.arcs.iter(word):
            end += 1
            if label[end] is None:
                begin = end - (found & 0xFFFFF)
                before = label[begin]
                if before is not None:
                    token = found >> 20
                    may = known.get(before << 20 | token)
                    if may or may is None and arc(before, token):
                        label[end], start[end] = token, begin
        out = []
        while n:
            if label[n] is None:
                raise ValueError("no path over the word: the merges are not in the order of construction")
            out.append(label[n])
            n = start[n]
        out.reverse()
        return out


def _spelled(token: str) -> str:
    return token[:-4] + END if token.endswith("</w>") and len(token) > 4 else token


class _Memory(dict):
    """Encodings seen by this worker, made on first sight."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Codec:
    """Encoder and decoder of one tokenizer file (special tokens, NFC, lower case, split, merges)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.automaton = Automaton(vocab, [tuple(m) for m in spec["model"]["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]
        self._marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        (split,) = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self._split = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self._bytes = byte_symbols()
        self._word = _Memory(self._encode_word)
        self._chunk = _Memory(self._encode_chunk)

    def _encode_word(self, word: str) -> bytes:
        spelled = "".join([self._bytes[b] for b in word.encode()]) + END
        return array("i", self.automaton.tokens(spelled)).tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        words = self._split.findall(chunk)
        return self._encode_word(chunk) if len(words) == 1 else b"".join(map(self._word.__getitem__, words))

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        # Character by character, so a final capital sigma becomes the plain one.
        text = text.replace("\u03a3", "\u03c3").lower()
        if _ODD_SPACE.search(text):
            return b"".join([self._word[w] for w in self._split.findall(text)])
        # No token crosses white space, so whole chunks between it are remembered.
        return b"".join(map(self._chunk.__getitem__, text.split()))

    def encode(self, text: str | None) -> bytes:
        """Ids as packed 32-bit integers; NULL is empty."""
        if not text:
            return b""
        out, at = [], 0
        for m in self._marks.finditer(text):
            out += [self._plain(text[at: m.start()]), np.int32(self.special[m.group()]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs taken; a vocabulary with marked word ends joins them by spaces."""
        return " ".join(map(self.labels.__getitem__, ids))


#: White space as the split pattern means it; Python's own split also knows four more characters.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One compiled codec per process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text and the text those ids decode to.

    ``path`` is the tokenizer file, present on every machine like the library that ships it. A NULL or
    empty text has no ids and decodes to the empty string; repeated rows stay; other columns are left
    out; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in slices(batch, text):
                ids = [tool.encode(t) for t in part.column(text).to_pylist()]
                texts = [tool.decode(np.frombuffer(i, np.int32).tolist()) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), string_list(ids, np.int32), pa.array(texts, pa.string())],
                    [key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token count and hashes of ids and decoded text."""
    return coded.select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
