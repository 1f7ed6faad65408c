"""Bundles: an exact round trip, revisits, the seek table."""

import hashlib

import zstandard
from pyarrow import fs

from voltweave.llm import warc
from voltweave.runtime import scratch_path

SCHEMA = "page_id long, url string, html string, digest string"


def pages(spark):
    big, other = "<p>ä</p>" * 400, "x" * 1000
    rows = [(1, "http://a/ü b\n", big), (2, None, big), (3, "http://c", big), (4, "u", None), (5, "u", ""), (6, "u", "s\r\n\r\nt"), (7, "u", "s\r\n\r\nt"),
            (8, "u", other), (9, "u", "y" * 3_000_000), (None, "u", other), (3, "again", big), (None, "v", "z" * 1200), (None, "w", "z" * 1200)]
    return spark.createDataFrame([(*r, "d") for r in rows], SCHEMA), rows


def test_round_trip(spark):
    df, rows = pages(spark)
    got = warc.archive(df.repartition(3)).collect()
    assert len(got) == len(rows)
    texts = sorted(((p, h or "") for p, _, h in rows), key=str)
    assert sorted(((r.page_id, r.payload_digest) for r in got), key=str) == sorted(((p, hashlib.sha1(h.encode()).hexdigest()) for p, h in texts), key=str)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    assert [(r.record_type, r.refers_to) for k in (1, 2) for r in by[k]] == [("revisit", 3)] * 2
    assert [r.record_type for k in (3, 4, 5, 6, 7, 8, 9) for r in by[k]] == ["response"] * 8
    assert sorted((r.record_type, str(r.refers_to)) for r in by[None]) == [("response", "None"), ("response", "None"), ("revisit", "8")]


def test_seek_table_and_plain_decompression(spark):
    df, _ = pages(spark)
    folder = scratch_path(spark, "bundles")
    index = warc.write(warc.plan(df.coalesce(1)), folder).collect()
    name = index[0].bundle
    reader = warc.Reader(folder, name)
    store, root = fs.FileSystem.from_uri(folder)
    whole = zstandard.ZstdDecompressor().stream_reader(store.open_input_file(f"{root}/{name}").read(), read_across_frames=True).read()
    assert whole == b"".join(reader.frame(k) for k in range(len(reader.sizes))) and len(reader.sizes) > 2
    for r in index:
        assert warc.parse(reader.frame(r.frame)[r.place: r.place + r.length])["page_id"] == r.page_id


def test_empty_table(spark):
    df, _ = pages(spark)
    assert warc.archive(df.limit(0)).collect() == []
