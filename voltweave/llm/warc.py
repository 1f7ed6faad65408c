"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that can be read alone; a bundle ends with the seek table of the
Zstandard seekable format (a skippable frame with the sizes of all others). The index maps each
record to its bundle, frame and place within the frame, so reading one record costs one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.runtime import cut, scratch_path

#: Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 1000
FRAME_BYTES = 256 * 1024
#: Frames read by a task.
TASK_FRAMES = 48
BUNDLE_BYTES = 512 * 1024 * 1024
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def plan(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, refers_to`` for every page.

    Of pages with equal payloads of ``REVISIT_BYTES`` or more the one with the largest page_id is stored,
    the others (and those without an id, if any has one) refer to it; rows that tie for it are all
    stored. A NULL html is an empty payload.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("_digest", F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha1("html")))
    kept = (
        rows.where("_digest IS NOT NULL").groupBy("_digest")
        .agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return rows.join(kept, "_digest", "left").select(
        "page_id", "url", F.encode("html", "UTF-8").alias("payload"), refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries no body, but digest and size of the full payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=_URI)}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    body = HTTP + payload
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        body = HTTP
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


_URI = "".join(chr(c) for c in range(33, 127))


def parse(data: bytes) -> dict:
    """Fields of a record; the body is checked against its own digest and length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind = fields["WARC-Type"]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a record")
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["WARC-Payload-Length"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload,
        "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": digest, "record_type": kind,
        "refers_to": _page(fields.get("WARC-Refers-To", "")),
    }


def _page(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


class Bundle:
    """A bundle being written; it gets its name only when complete."""

    def __init__(self, folder: str):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{root}/{self.name}"
        self.out = self.store.open_output_stream(f"{self.path}.open")
        self.sizes: list[tuple[int, int]] = []
        self.written = 0
        self.frame: list[bytes] = []
        self.filled = 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, data: bytes) -> tuple[int, int]:
        """Number of the frame and place in it."""
        if self.filled and self.filled + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.sizes), self.filled
        self.frame.append(data)
        self.filled += len(data)
        return place

    def flush(self) -> None:
        packed = self.packer.compress(b"".join(self.frame))
        self.out.write(packed)
        self.sizes.append((len(packed), self.filled))
        self.written += len(packed)
        self.frame, self.filled = [], 0

    def close(self) -> None:
        if self.filled:
            self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.store.move(f"{self.path}.open", self.path)


class Reader:
    """Frames of a bundle by number."""

    def __init__(self, folder: str, name: str):
        store, root = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        sizes = np.frombuffer(self.file.read_at(8 * count, end - 9 - 8 * count), "<u4").reshape(count, 2)
        self.sizes = sizes.astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes[:, 0])))

    def frame(self, k: int) -> bytes:
        packed = self.file.read_at(int(self.sizes[k, 0]), int(self.starts[k]))
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.sizes[k, 1]))


INDEX = "page_id long, bundle string, frame int, place long, length long"
READ = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long")


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write bundles below ``folder`` (any store that pyarrow opens by its address) and return the index.

    A task writes whole bundles; a repeated attempt writes new ones, and the index names those of the
    attempt that counted. The index is written too, so the bundles are made once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "refers_to")}
                data = record(**row)
                if bundle is None:
                    bundle = Bundle(folder)
                frame, place = bundle.add(data)
                rows.append((row["page_id"], bundle.name, frame, place, len(data)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    yield _index(rows)
                    bundle, rows = None, []
        if bundle is not None:
            bundle.close()
            yield _index(rows)

    return cut(planned.select("page_id", "url", "payload", "refers_to").mapInArrow(run, INDEX))


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    names = ["page_id", "bundle", "frame", "place", "length"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that an index names, each frame unpacked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, number, reader, data = None, None, None, b""
        for batch in batches:
            out, size = [], 0
            for bundle, frame, place, length in zip(*[batch.column(c).to_pylist() for c in ("bundle", "frame", "place", "length")]):
                if bundle != name:
                    name, number, reader = bundle, None, Reader(folder, bundle)
                if frame != number:
                    number, data = frame, reader.frame(frame)
                out.append(parse(data[place: place + length]))
                size += length
                if size > 16 * FRAME_BYTES:
                    yield pa.RecordBatch.from_pylist(out, _READ)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _READ)

    # By number of frames: the index is small, and its size says nothing of the work behind it.
    tasks = max(1, index.select("bundle", "frame").distinct().count() // TASK_FRAMES)
    sorted_ = index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "place")
    return sorted_.select("bundle", "frame", "place", "length").mapInArrow(run, READ)


_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages below ``folder`` (by default one of their own in the shared folder) and read them back.

    An empty table writes no bundle; other columns are left out; pages of any size fit (a large record
    is a frame of its own).
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read(write(plan(pages), folder), folder)
