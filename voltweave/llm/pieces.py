"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, by an agenda of symbol pairs.

A text starts as single characters. Every adjacent pair whose concatenation is a piece stands on an
agenda ordered by the piece's score (ties: the leftmost pair); the best pair is joined, its new
neighbours are put on the agenda, and entries whose symbols have changed since are skipped. Characters
without a piece fall back to their bytes.

Texts are cut where no piece can reach across: a space symbol behind another character, unless the
vocabulary has a piece with one. Chunks between cuts are encoded once per worker. Every Arrow batch
can be checked against the sentencepiece library as it is made.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.llm.tables import slices

MODEL = "piece_bpe_32k.model"
#: The symbol that stands for a space.
SPACE = "▁"
_CONTROL = b"\xff\xff"
#: Chunks remembered by a worker; above it the memory is emptied and filled anew. Longer ones are not kept.
MEMORY, MEMORY_CHARS = 800_000, 64


class _Chunks(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > MEMORY_CHARS:
            return self.make(chunk)
        if len(self) >= MEMORY:
            self.clear()
        value = self[chunk] = self.make(chunk)
        return value


class Codec:
    """Encoder and decoder of one model file.

    Only what this kind of model states is done: identity normalisation, spaces as symbols, one put before
    the text, bytes for unknown characters. Other models are refused.
    """

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        reserved = {self.unknown, *[k for k in range(size) if sp.is_control(k) or sp.is_byte(k)]}
        if not all(sp.is_byte(b) for b in self.bytes):
            raise ValueError("the model has no byte pieces")
        if any(sp.is_unused(k) for k in range(size)) or sp.encode("x  ﬁ", out_type=str, add_bos=False)[0][0] != SPACE:
            raise ValueError("only models with a space before the text and without unused pieces")
        pieces = {sp.id_to_piece(k): k for k in range(size) if k not in reserved}
        self.ids = pieces
        #: Places of pieces on the agenda: the best score has the smallest, equal scores share one.
        places = {s: k for k, s in enumerate(sorted({sp.get_score(k) for k in pieces.values()}, reverse=True))}
        self.place = {p: places[sp.get_score(k)] for p, k in pieces.items()}
        crossing = any(SPACE in p.lstrip(SPACE) for p in pieces)
        self._cut = re.compile("(?s:.+)" if crossing else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._crossing = crossing
        #: The bytes behind each id; byte pieces stand for one byte, control pieces for what no text has.
        self.surface = [p.replace(SPACE, " ").encode() for p in map(sp.id_to_piece, range(size))]
        for k in range(size):
            if sp.is_control(k):
                self.surface[k] = _CONTROL
        for b, k in enumerate(self.bytes):
            self.surface[k] = bytes([b])
        self.surface[self.unknown] = " ⁇ ".encode()
        self._opens = [p.startswith(SPACE) and k not in reserved for k, p in enumerate(map(sp.id_to_piece, range(size)))]
        self._is_byte = [sp.is_byte(k) for k in range(size)]
        self._chunk = _Chunks(self._agenda)
        self._word = _Chunks(lambda w: self._agenda(SPACE + w))
        self._ends = tuple(np.uint32(k).astype("<u4").tobytes() for k in (self.begin, self.end))

    def _agenda(self, chunk: str) -> bytes:
        """Ids of one chunk as packed 32-bit integers."""
        place, n = self.place.get, len(chunk)
        symbol = list(chunk)
        before, after = list(range(-1, n - 1)), [*range(1, n), 0]
        # The place of the pair that starts at a symbol now; an entry with another one is outdated.
        now = [*map(place, map(add, chunk, chunk[1:])), None]
        agenda = [p << 32 | k for k, p in enumerate(now) if p is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry & 0xFFFFFFFF
            if now[left] != entry >> 32:
                continue
            right = after[left]
            both = symbol[left] = symbol[left] + symbol[right]
            symbol[right], now[right] = "", None
            behind = after[left] = after[right]
            found = None
            if behind:
                before[behind] = left
                found = place(both + symbol[behind])
                if found is not None:
                    heappush(agenda, found << 32 | left)
            now[left] = found
            first = before[left]
            if first >= 0:
                found = now[first] = place(symbol[first] + both)
                if found is not None:
                    heappush(agenda, found << 32 | first)
        ids = []
        for s in symbol:
            if s:
                found = self.ids.get(s)
                if found is None:
                    ids += [self.bytes[b] for b in s.encode()]
                else:
                    ids.append(found)
        packed = array("I", ids)
        if sys.byteorder != "little":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Begin id, ids of the text, end id, packed as little-endian unsigned 32-bit integers; NULL is empty."""
        if not text:
            return b"".join(self._ends)
        if self._crossing or text[0] == " " or "  " in text or SPACE in text:
            chunks = self._cut.findall(SPACE + text.replace(" ", SPACE))
            body = map(self._chunk.__getitem__, chunks)
        else:  # single spaces: every word with the symbol before it is a chunk
            body = map(self._word.__getitem__, text.split(" "))
        return b"".join((self._ends[0], *body, self._ends[1]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: surfaces joined, one space symbol at the start dropped, bytes read as UTF-8.

        A byte that belongs to no character gives U+FFFD.
        """
        ids = ids[ids[:1] == [self.begin]: len(ids) - (len(ids) > 1 and ids[-1] == self.end)]
        data = b"".join(map(self.surface.__getitem__, ids))
        try:
            found = data.decode()
        except UnicodeDecodeError:
            found = self._by_runs(ids)
        first = next((k for k in ids if self.surface[k] != _CONTROL), self.unknown)
        return found[1:] if self._opens[first] else found

    def _by_runs(self, ids: list[int]) -> str:
        """Surfaces by runs of byte pieces, which control pieces end."""
        out = []
        for is_byte, run in groupby(ids, self._is_byte.__getitem__):
            data = b"".join([self.surface[k] for k in run if self.surface[k] != _CONTROL or is_byte])
            while data:
                try:
                    out.append(data.decode())
                    break
                except UnicodeDecodeError as e:
                    out += [data[: e.start].decode(), "\ufffd"]
                    data = data[e.start + 1:]
        return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", check: bool = False) -> DataFrame:
    """``ids`` (packed little-endian unsigned 32-bit integers, with begin and end id) of every whole text and
    ``decoded``, the text those ids decode to.

    With ``check`` every Arrow batch is encoded and decoded by the sentencepiece library as well, and a
    difference is an error. ``path`` is the model file, present on every machine. A NULL or empty text
    has the begin and end id only and decodes to the empty string; equal scores go to the leftmost pair;
    repeated rows and NULL keys stay; other columns are left out; an empty table gives an empty result. A text
    without a space is one chunk, whose agenda takes some 300 bytes a character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                ids = [tool.encode(t) for t in texts]
                decoded = [tool.decode(unpacked(i).tolist()) for i in ids]
                if check:
                    compare(tool, texts, ids, decoded)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids binary, decoded string")


def compare(tool: Codec, texts: list[str | None], ids: list[bytes], decoded: list[str]) -> None:
    """An error if the library gives other ids or another text for one of a batch."""
    known = tool.library.encode([t or "" for t in texts], add_bos=True, add_eos=True, num_threads=1)
    for k, (own, other) in enumerate(zip(ids, known)):
        if own != np.array(other, "<u4").tobytes():
            raise ValueError(f"ids differ from the library's for {(texts[k] or '')[:200]!r}")
    for k, (own, other) in enumerate(zip(decoded, tool.library.decode(known, num_threads=1))):
        if own != other:
            raise ValueError(f"decoding differs from the library's for {(texts[k] or '')[:200]!r}")


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token count and hashes of ids and decoded text."""
    return coded.select(
        key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
