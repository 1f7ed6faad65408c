"""SimHash near-duplicate groups, with pigeonring filtering of candidates.

Fingerprints of 64 bits are cut into a ring of ``SEGMENTS`` segments. If two of them differ in at most
``radius`` bits, then from some segment on every chain of l consecutive segments differs in at most
``l * radius / SEGMENTS`` bits. For radius 3 and eight segments the budgets are 0, 0, 1, 1, 1, 2, 2, 3:
two segments are equal, and of the next three two more are. So each fingerprint is filed under 24
keys of 32 equal bits, and only fingerprints under one key are candidates; the chain budgets prune
them once more before the full Hamming check.

Work is done on distinct fingerprints (copies cost nothing), and links inside a bucket are reported as
a spanning forest, so a dense bucket yields no more rows than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.llm.components import components
from voltweave.llm.tables import row_hash, slices
from voltweave.runtime import cut

SEED = 42
SHINGLE = 3
RADIUS = 3
SEGMENTS = 8
WIDTH = 64 // SEGMENTS


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without words."""
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return 0
    gaps = [-1, *_find_all(joined)]
    n = max(1, len(gaps) - SHINGLE + 1)
    stops = [*gaps[SHINGLE:], len(joined)][-n:]
    hashed = np.fromiter(
        map(xxhash.xxh64_intdigest, [joined[a + 1: b] for a, b in zip(gaps, stops)], repeat(SEED)), np.uint64, n)
    return majority(hashed)


def majority(hashed: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    ones = np.unpackbits(hashed.view(np.uint8).reshape(len(hashed), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.uint64)[0])


def _find_all(joined: bytes) -> list[int]:
    return np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns and ``fp`` (signed 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                fps = np.array([fingerprint(t) for t in part.column(text).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(fps)], [*keys, "fp"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, text).mapInArrow(run, f"{schema}, fp long")


def budgets(radius: int = RADIUS) -> list[int]:
    """Bits by which a chain of l = 1, 2, ... segments may differ."""
    return [length * radius // SEGMENTS for length in range(1, SEGMENTS + 1)]


def key_masks(radius: int = RADIUS) -> list[int]:
    """Masks of the bits under which a fingerprint is filed.

    From a start the chain is followed as long as its budget is at most one bit; of the segments after
    the equal ones all but one are then equal, whichever that is.
    """
    allowed = budgets(radius)
    equal = sum(b == 0 for b in allowed)
    loose = sum(b == 1 for b in allowed)
    masks = []
    for start in range(SEGMENTS):
        for kept in combinations(range(equal, equal + loose), max(0, loose - 1)):
            chain = [*range(equal), *kept]
            masks.append(sum((1 << WIDTH) - 1 << WIDTH * ((start + k) % SEGMENTS) for k in chain))
    return masks


#: Members of a bucket compared pair by pair in one numpy block.
BLOCK = 1024


def within(x: np.ndarray, radius: int) -> np.ndarray:
    """Whether differences (XOR of fingerprints) pass the chain budgets and the full check."""
    parts = np.bitwise_count(np.ascontiguousarray(x)[..., None].view(np.uint8))
    if WIDTH != 8:
        raise ValueError("segments are bytes")
    alive = np.zeros(x.shape, bool)
    ring = np.concatenate([parts, parts], axis=-1)
    for start in range(SEGMENTS):
        chain = np.cumsum(ring[..., start: start + SEGMENTS], axis=-1)
        alive |= (chain <= np.array(budgets(radius), np.uint8)).all(axis=-1)
    alive[alive] = np.bitwise_count(x[alive]) <= radius
    return alive


def forest(fps: np.ndarray, radius: int = RADIUS, free: int = (1 << 64) - 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the links of a bucket connect.

    ``free`` are the bits in which its members may differ. A bucket above ``BLOCK`` is filed anew under
    each of radius + 1 parts of those bits, one of which two linked members share, so it never becomes
    a table of all pairs; parts that no longer split it are compared block by block.
    """
    n = len(fps)
    if n < 2:
        return []
    if n <= BLOCK:
        return [_tree(fps, fps, radius)]
    bits = [k for k in range(64) if free >> k & 1]
    out = []
    for part in np.array_split(np.array(bits, dtype=object), radius + 1):
        mask = sum(1 << int(k) for k in part)
        own = fps & np.uint64(mask)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        for group in np.split(order, cuts):
            if len(group) == n or not mask:
                for i in range(0, n, BLOCK):
                    for j in range(i, n, BLOCK):
                        out.append(_tree(fps[i: i + BLOCK], fps[j: j + BLOCK], radius))
            elif len(group) > 1:
                out += forest(fps[group], radius, free & ~mask)
    return out


def _tree(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two blocks."""
    i, j = np.nonzero(within(left[:, None] ^ right[None, :], radius))
    a, b = left[i], right[j]
    apart = a != b
    a, b = a[apart], b[apart]
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    if not len(names):
        return a, b
    # Smallest label over the links until nothing changes: at most the longest path of a block.
    label = np.arange(len(names))
    u, v = ends[: len(a)], ends[len(a):]
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` of the distinct fingerprints in ``fps`` that join the same groups as all links do."""
    masks = [m - (1 << 64) if m >> 63 else m for m in key_masks(radius)]
    filed = fps.select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("chain", "key"))
    filed = filed.repartition("chain", "key").sortWithinPartitions("chain", "key")
    free = [~m & (1 << 64) - 1 for m in key_masks(radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("chain", "key", "fp")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            chain, key, fp = now
            # Complete runs of one key; the last one may go on in the next batch.
            cuts = np.flatnonzero((np.diff(chain) != 0) | (np.diff(key) != 0)) + 1
            last = cuts[-1] if len(cuts) else 0
            yield from found(chain[:last], fp[:last].view(np.uint64), cuts[:-1] if len(cuts) else cuts)
            rest = [x[last:] for x in now]
        if rest is not None:
            yield from found(rest[0], rest[2].view(np.uint64), np.zeros(0, np.int64))

    def found(chain: np.ndarray, fp: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.concatenate(([0], cuts, [len(fp)]))
        trees = []
        for start, stop in zip(bounds[:-1], bounds[1:]):
            if stop - start > 1:
                trees += forest(fp[start:stop], radius, free[chain[start]])
        if trees:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*trees))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return filed.mapInArrow(run, "a long, b long").distinct()


def groups(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, component`` (a fingerprint standing for the group) for every distinct fingerprint with a link."""
    distinct = cut(fps.select("fp").distinct())
    return components(links(distinct, radius)).select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id of the group.

    Texts without a word (NULL, empty, white space) have fingerprint zero and are linked like others;
    rows without doc_id take part and get the id of their group (NULL if it has none); repeated rows
    stay; columns other than doc_id and text are left out; an empty table gives an empty result.
    """
    own = cut(fingerprints(docs, ["doc_id"]))
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = least.join(cut(groups(own, radius)), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(named, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group: that with the smallest doc_id (one without an id only if no other is there);
    of repeated rows one. All columns of ``docs`` stay as they are."""
    row = row_hash(docs).alias("_vw_row")
    own = cut(fingerprints(docs.select("doc_id", "text", row), ["doc_id", "_vw_row"]))
    return one_each(docs, own.join(cut(groups(own, radius)), "fp", "left").withColumn("_vw_group", F.coalesce("component", "fp")))


def one_each(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each ``_vw_group`` that ``known`` gives by doc_id and row hash."""
    names = docs.columns
    first = known.groupBy("_vw_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_vw_row")).alias("_vw_first"))
    first = first.select(F.col("_vw_first.doc_id").alias("_vw_id"), F.col("_vw_first._vw_row").alias("_vw_row")).distinct()
    kept = docs.withColumn("_vw_row", row_hash(docs)).join(first, "_vw_row").where(F.col("doc_id").eqNullSafe(F.col("_vw_id")))
    return kept.dropDuplicates(["_vw_row"]).select(*[F.col(f"`{c}`") for c in names])
