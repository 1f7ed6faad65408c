"""Near copies by Jaccard similarity of word shingles, without a probabilistic step.

A text is the set of the hashes of its five-word shingles. Operator 8 goes first: the sets' majority fingerprints are searched by
the chains of ring segments of ``simhash_dedup``, whose spanning forest is checked exactly. Its 3 bits miss many texts that are 0.8
alike, so an exact search follows for those that are not joined yet. With the shingles of all texts in one order, two
sets that are at least 4/5 alike share a shingle among the first n // 5 + 1 of each: sets are filed under
these and only those under one key are candidates. Shingles are ordered by how often all texts together fall
on their place of a table of fixed size, so common ones stand last and are hardly ever keys; the order decides what
the search costs, never what it finds.

A candidate pair is checked by parity bitmaps first: a set's shingles flip bits of a map about as wide as the
set is large, and two maps differ in no more bits than their sets do in shingles, so pairs that differ
in too many are not alike. Those that are left are compared exactly. Texts travel for them alone, each to its
hub's task; large groups are dealt over several tasks, to which only the hub's text is copied.

Three more passes keep a group of many copies linear: first each set is compared with one hub per key and size
band, unless operator 8 has joined them; then all sets under a key that the first pass has not joined, whose bitmaps travel with the key, so that
only pairs that may be alike leave a task, and those under one of the first keys they share. Of these pairs a key hands on a few spanning forests over
the groups joined so far, the likeliest first; every pair that may be alike and is still apart after that follows in the last pass.
A pass goes on from the groups of the one before, not from its links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.llm import simhash_dedup
from voltweave.llm.components import components
from voltweave.llm.simhash_dedup import _find_all, majority, one_each
from voltweave.llm.tables import row_hash, slices, string_list
from voltweave.runtime import cut, discard

SEED = 42
SHINGLE = 5
#: Places of the table that shingles are counted in (a power of two), and of one of its rows.
PLACES, ROW_PLACES = 1 << 20, 1 << 12
#: Pairs of a key whose bitmaps are compared together, and members of a hub in one task.
PAIRS = 100_000
HUB_MEMBERS = 2048
#: Bytes of bitmaps compared at once.
PAIR_BYTES = 8_000_000
#: Spanning forests of a key's groups that are compared before all pairs.
FORESTS = 4
#: Bits of a bitmap at least, and keys before its own that travel with a row of a key.
BITS, AHEAD = 1024, 8


def shingles(text: str | None) -> np.ndarray:
    """Sorted different hashes of all shingles; a text of fewer words is one shingle, without words none."""
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = [-1, *_find_all(joined)]
    n = max(1, len(gaps) - SHINGLE + 1)
    stops = [*gaps[SHINGLE:], len(joined)][-n:]
    return np.unique(np.fromiter(
        map(xxhash.xxh64_intdigest, [joined[a + 1: b] for a, b in zip(gaps, stops)], repeat(SEED)), np.uint64, n))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 4/5 at least (two empty ones have)."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def bitmap(found: np.ndarray) -> bytes:
    """Parity of the hashes that fall on each bit; a power of two of bits, ``BITS`` and half as many as hashes at least."""
    width = max(BITS, 1 << max((len(found) - 1) // 2, 0).bit_length())
    odd = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_alike(a: bytes, b: bytes, n: int) -> bool:
    """Whether sets with these bitmaps and ``n`` shingles together can be alike: they differ in n / 9 at most."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):  # the wider one is folded, which leaves its parities right
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = y[: len(y) // 2] ^ y[len(y) // 2:]
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= n


def bits_apart(bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the maps of many pairs of rows differ, as in ``may_be_alike``; sizes differ by a quarter at most (so widths by one doubling)."""
    widths = np.array([len(x) for x in bits])
    out = np.zeros(len(i), np.int64)
    narrow = np.minimum(widths[i], widths[j])
    for width in np.unique(narrow).tolist():
        own = np.flatnonzero(narrow == width)
        rows = np.unique(np.concatenate([i[own], j[own]]))
        maps = np.zeros((len(rows), width), np.uint8)
        for k, row in enumerate(rows.tolist()):
            x = np.frombuffer(bits[row], np.uint8)
            while len(x) > width:
                x = x[: len(x) // 2] ^ x[len(x) // 2:]
            maps[k] = x
        left, right = np.searchsorted(rows, i[own]), np.searchsorted(rows, j[own])
        step = max(1, PAIR_BYTES // width)
        for k in range(0, len(own), step):
            part = slice(k, k + step)
            out[own[part]] = np.bitwise_count(maps[left[part]] ^ maps[right[part]]).sum(axis=1, dtype=np.int64)
    return out


def near_bitmaps(bits: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``may_be_alike`` of many pairs of rows."""
    return 9 * bits_apart(bits, i, j) <= n[i] + n[j]


def prefix(found: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 shingles: those on rarer places of ``times`` first, then by hash."""
    seen = times[(found & np.uint64(len(times) - 1)).astype(np.int64)]
    return found[np.lexsort((found, seen))[: len(found) // 5 + 1]]


def _times(docs: DataFrame) -> np.ndarray:
    """How many shingles of all texts (once for each text) fall on each place; ``PLACES`` numbers pass through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(PLACES, np.int64)
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    np.add.at(times, (shingles(text) & np.uint64(PLACES - 1)).astype(np.int64), 1)
        rows = times.reshape(-1, ROW_PLACES)
        used = np.flatnonzero(rows.any(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * ROW_PLACES), pa.array(rows[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), lists], ["row", "times"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, times in zip(batch.column("row").to_pylist(), batch.column("times")):
                sums[row] = sums.get(row, 0) + times.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["row", "times"])

    kind = "row int, times array<long>"
    total = docs.select("text").mapInArrow(run, kind).repartition("row").mapInArrow(add, kind)
    out = np.zeros(PLACES, np.int64)
    found = total.toArrow()
    for row, times in zip(found["row"].to_pylist(), found["times"]):
        out[row * ROW_PLACES: (row + 1) * ROW_PLACES] += times.values.to_numpy()
    return out


def _sets(docs: DataFrame, times: np.ndarray) -> DataFrame:
    """``doc_id, _vw_row``, a hash of the shingle set, its size, bitmap and fingerprint and the keys it is filed under."""
    # Ranks of the counts need four bytes each: 4 MB at any size of the input.
    ranks = np.unique(times, return_inverse=True)[1].astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                digests = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                keys = string_list([prefix(s, shared.value).tobytes() for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_vw_row"), pa.array(digests), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([bitmap(s) for s in sets], pa.binary()), pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)), keys],
                    ["doc_id", "_vw_row", "set", "n", "bits", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, _vw_row long, set long, n long, bits binary, fp long, keys array<long>")


def _by_key(filed: DataFrame, found: Callable[[dict[str, np.ndarray], np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``found`` over complete runs of one key: the columns, by key and size, and the bounds of the runs."""
    names = filed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[dict[str, np.ndarray]] = []
        for batch in batches:
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if not batch.num_rows:
                continue
            if rest and now["key"][-1] == rest[0]["key"][0]:
                rest.append(now)  # one long run goes on
                continue
            now = {c: np.concatenate([*[r[c] for r in rest], now[c]]) for c in names}
            cuts = np.flatnonzero(np.diff(now["key"])) + 1
            last = cuts[-1] if len(cuts) else 0
            if last:
                yield from found({c: v[:last] for c, v in now.items()}, np.concatenate(([0], cuts)))
            rest = [{c: v[last:] for c, v in now.items()}]
        if rest:
            now = {c: np.concatenate([r[c] for r in rest]) for c in names}
            yield from found(now, np.array([0, len(now["key"])]))

    return filed.repartition("key").sortWithinPartitions("key", "n", "set").mapInArrow(run, schema)


def _several(rows: dict[str, np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of keys with more than one member."""
    sizes = np.diff(bounds)
    keep = np.repeat(sizes > 1, sizes)
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.array(rows[c][keep]) for c in ("key", "set", "n")], ["key", "set", "n"])


def _joins(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs, in their order, join two groups of ``label`` (a root for each row); the labels follow."""
    up = {}

    def root(x: int) -> int:
        while x in up:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    joins = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist())):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            joins[k] = True
    moved = np.array(sorted(up), np.int64)
    now = np.arange(len(label))
    now[moved] = [root(x) for x in moved.tolist()]
    label[:] = now[label]
    return joins


def _apart(rows: dict[str, np.ndarray], bounds: np.ndarray, every: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs ``hub, member`` of one key that are near enough in size and in bits and in different groups.

    A pair that shares one of the keys ahead of this one is left to that key, whose rows it is among too. Of the others ``FORESTS``
    spanning forests of the key's groups stay, the nearest first, each of the pairs that those before leave. With ``every`` all stay.
    """
    node, n, bits = rows["set"], rows["n"], rows["bits"]
    ahead = np.stack([rows[f"ahead{k}"] for k in range(AHEAD)], axis=1)
    # The group of a row within its key is named by the first of its rows.
    order = np.lexsort((rows["component"], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
    key, component = rows["key"][order], rows["component"][order]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(component) != 0))))
    group = np.empty(len(node), np.int64)
    group[order] = np.repeat(order[starts], np.diff(np.append(starts, len(node))))
    forests = [] if every else [group.copy() for _ in range(FORESTS)]
    last = forests[-1] if forests else group
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def near() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held))
        held.clear()
        differ, size = bits_apart(bits, a, b), n[a] + n[b]
        alive = np.flatnonzero(9 * differ <= size)
        alive = alive[np.argsort(differ[alive] / size[alive], kind="stable")]
        a, b = a[alive], b[alive]
        x, y = ahead[a], ahead[b]
        first = ~((x[:, :, None] == y[:, None, :]) & (x[:, :, None] != 0)).any(axis=(1, 2))
        a, b = a[first], b[first]
        stays = np.full(len(a), every)
        for label in forests:
            left = np.flatnonzero(~stays)
            stays[left[_joins(label, a[left], b[left])]] = True
        a, b = node[a[stays]], node[b[stays]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["hub", "member"])

    # Each row meets the row d behind it, for all rows at once; sizes rise within a key, so one that is too long ends it.
    stop, one, d = np.repeat(bounds[1:], np.diff(bounds)), np.arange(len(node)), 0
    while len(one):
        d += 1
        one = one[one + d < stop[one]]
        one = one[5 * n[one] >= 4 * n[one + d]]
        apart = one[last[one] != last[one + d]]
        if len(apart):
            held.append((apart, apart + d))
        if sum(len(a) for a, _ in held) > PAIRS or held and not len(one):
            yield near()


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``hub, member`` that the bitmaps leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n = (batch.column(c).to_pylist() for c in ("x", "y", "n"))
            keep = pa.array(list(map(may_be_alike, x, y, n)), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("member")], ["hub", "member"]).filter(keep)

    both = pairs.join(sets.select(F.col("set").alias("member"), F.col("bits").alias("y"), F.col("n").alias("_n")), "member")
    both = both.join(sets.select(F.col("set").alias("hub"), F.col("bits").alias("x"), F.col("n").alias("_m")), "hub")
    return both.select("hub", "member", "x", "y", (F.col("_n") + F.col("_m")).alias("n")).mapInArrow(run, "hub long, member long")


def _by_fingerprint(marked: DataFrame) -> DataFrame:
    """Pairs ``hub, member`` of sets that operator 8 links: one row for each link of its forest and each further set of a fingerprint."""
    first = cut(marked.groupBy("fp").agg(F.min("set").alias("hub")))
    same = marked.join(first, "fp").where("set != hub").select("hub", F.col("set").alias("member"))
    found = simhash_dedup.links(first.select("fp"))
    for end in ("a", "b"):
        found = found.join(first.select(F.col("fp").alias(end), F.col("hub").alias(f"{end}_set")), end)
    return same.unionByName(found.select(F.least("a_set", "b_set").alias("hub"), F.greatest("a_set", "b_set").alias("member")))


def _apart_in(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs ``hub, member`` that the groups of ``known`` (node, component) do not join."""
    for end in ("hub", "member"):
        pairs = pairs.join(known.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
    return pairs.where(~F.coalesce(F.col("_hub") == F.col("_member"), F.lit(False))).select("hub", "member")


def _stars(known: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the groups of ``known``, one for each member."""
    return known.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _unjoined(filed: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of keys with sets of several groups: their group, bitmap and the keys ahead."""
    grouped = filed.join(known.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    grouped = cut(grouped.select("key", "set", "n", "component"))
    several = grouped.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high")
    left = grouped.join(several.select("key"), "key").join(sets.select("set", "bits", "keys"), "set")
    at = (F.array_position("keys", F.col("key")) - 1).cast("int")
    ahead = [F.coalesce(F.get("keys", at - k - 1), F.lit(0)).alias(f"ahead{k}") for k in range(AHEAD)]
    left = cut(left.select("key", "set", "n", "component", "bits", *ahead))
    discard(grouped)
    return left


def _linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """``a, b``: the pairs whose sets are alike. ``sets`` has a row of ``docs`` (by ``_vw_row``) for each set."""
    pairs = cut(pairs)
    dealt = cut(pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_MEMBERS).alias("parts")))
    needed = pairs.select(F.explode(F.array("hub", "member")).alias("set")).distinct().join(sets.select("set", "_vw_row"), "set")
    texts = docs.select(row_hash(docs).alias("_vw_row"), "text").join(needed, "_vw_row")
    # Repeated rows have one hash.
    texts = cut(texts.select("set", "text").dropDuplicates(["set"]))
    members = pairs.join(dealt, "hub").select(
        "hub", F.pmod(F.xxhash64("member"), F.col("parts")).alias("part"), F.col("member").alias("set"))
    hubs = dealt.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("hub").alias("set"))
    rows = hubs.unionByName(members).join(texts, "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hub's text comes first in each part, then those of its members."""
        hub, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for part in slices(batch):
                for h, s, text in zip(*[part.column(c).to_pylist() for c in ("hub", "set", "text")]):
                    found = shingles(text)
                    if h == s:
                        hub, known = h, found
                    elif h == hub and alike(known, found):
                        a.append(h)
                        b.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("set") != F.col("hub"))
    links = cut(ordered.select("hub", "set", "text").mapInArrow(run, "a long, b long"))
    discard(pairs, dealt, texts)
    return links


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of texts that are linked by a similarity of 4/5 at least: that with the smallest
    doc_id (one without an id only if no other is there); of repeated rows one. All columns stay as they are.

    Texts without a word are one group. An empty table stays empty.
    """
    row = row_hash(docs).alias("_vw_row")
    own = cut(_sets(docs.select("doc_id", "text", row), _times(docs)))
    rows = cut(own.select("doc_id", "_vw_row", "set"))
    # One row stands for all texts of one set.
    first = own.groupBy("set").agg(F.min("_vw_row").alias("_vw_row"))
    # Joined by set alone, so that the rows are dealt out once.
    each = own.join(first.withColumnRenamed("_vw_row", "_vw_first"), "set").where("_vw_row = _vw_first").dropDuplicates(["set"])
    filed = each.select("set", "n", F.explode("keys").alias("key"))
    filed = cut(_by_key(filed, _several, "key long, set long, n long"))
    sets = own.select("set", "_vw_row", "n", "bits", "keys").join(filed.select("set").distinct(), "set", "left_semi")
    sets = cut(sets.join(first, ["set", "_vw_row"], "left_semi").dropDuplicates(["set"]))
    # A set without a key in common with another one is alike to none.
    marked = cut(own.select("set", "fp").distinct().join(sets.select("set"), "set", "left_semi"))
    discard(own)
    near = _linked(_by_fingerprint(marked), sets, docs)
    joined = cut(components(near))

    # Bands of sizes: the hub of a band is its smallest set.
    banded = filed.withColumn("band", F.floor(F.log(1.25, F.col("n"))))
    hubs = banded.groupBy("key", "band").agg(F.min("set").alias("hub"))
    pairs = banded.join(hubs, ["key", "band"]).where("set != hub").select("hub", F.col("set").alias("member")).distinct()
    links = _linked(_possible(_apart_in(pairs, joined), sets), sets, docs)
    known = cut(components(_stars(joined).unionByName(links)))
    discard(near, joined, links)
    for pick in (_apart, partial(_apart, every=True)):
        left = _unjoined(filed, known, sets)
        links = _linked(_by_key(left, pick, "hub long, member long").distinct(), sets, docs)
        groups = cut(components(_stars(known).unionByName(links)))
        discard(left, known, links)
        known = groups
    discard(filed, sets, marked)
    found = rows.join(known.withColumnRenamed("node", "set"), "set", "left")
    return one_each(docs, found.withColumn("_vw_group", F.coalesce("component", "set")))
