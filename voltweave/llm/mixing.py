"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are dealt into blocks. Block i of a source of weight w is released at slot
floor((i - 1) / w) and due by slot ceil(i / w); each slot goes to the released block with the earliest
deadline. With weights that sum to one every deadline is met, so after any number t of slots a source
has had w * t blocks, give or take less than one.

Weights are taken as they are, as exact fractions, and the schedule never repeats, so the bound holds for
any number of slots. A source that has run out leaves its slots free; the others go on at their own release times, which
a slot without a released block jumps to, so the plan takes a step for each block, whatever the weights. Every document appears once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltweave.llm.tables import row_hash
from voltweave.runtime import cut

#: Slots of a period of whole shares (``shares``, ``period``); a mixture has none.
GRAIN = 2048
#: Blocks of the plan in one batch.
PLAN_ROWS = 50_000
BLOCK = 64
#: Sources that a mixture may have; counts and weights of all pass through the driver.
MAX_SOURCES = 20_000
#: Documents of a source that are ranked together.
PART_ROWS = 2000


def shares(weights: dict[str, float], grain: int) -> dict[str, int]:
    """Whole slots per period for every source: largest remainders, one at least."""
    total = sum(weights.values())
    exact = {s: w / total * grain for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    rest = grain - sum(out.values())
    by_rest = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    for s in by_rest[: max(0, rest)]:
        out[s] += 1
    while rest < 0:
        s = max(out, key=lambda x: (out[x], x))
        out[s] -= 1
        rest += 1
    return out


def schedule(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """Source, block, slot, release and deadline of the first ``blocks`` of every source, by slot.

    The time is that of the blocks, not of the slots between them; memory is that of the sources.
    """
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*[w.denominator for w in exact.values()])
    part = {s: int(w * unit) for s, w in exact.items()}
    total, left, slot = sum(part.values()), sum(blocks.values()), 0
    waiting = [(0, s, 0) for s in part if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    while left:
        if not ready and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            release, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // part[s]), s, i, release))
        deadline, s, i, release = heapq.heappop(ready)
        yield s, i, slot, release, deadline
        left -= 1
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * total // part[s], s, i + 1))
        slot += 1


def period(slots: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period of whole slots: source, block in the period, its slot, release and deadline."""
    return list(schedule(slots, slots))


def _plan(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int]) -> DataFrame:
    """Slot of every block, written by one task: its rows are blocks, not documents."""
    names = ["_vw_source", "_vw_block", "_vw_slot"]
    kinds = [pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = schedule(weights, blocks) if batch.num_rows else iter(())
            while some := [r[:3] for r in islice(rows, PLAN_ROWS)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    # Written, so that it is planned once and the planner knows its size.
    return cut(spark.range(1, numPartitions=1).mapInArrow(run, "_vw_source string, _vw_block long, _vw_slot long"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, source: str = "source",
        names: tuple[str, str, str] = ("block", "slot", "place")) -> DataFrame:
    """All rows of ``docs`` with ``block`` (number within the source), ``slot`` and ``place`` within the block.

    Without ``weights`` a source counts by the root of its size. A source without a positive weight is
    an error. NULL counts as the source of that name ''. The order within a source is by a hash of the row;
    repeated rows follow each other. Columns of the same names are replaced; an empty table stays empty.
    """
    # A hash of the whole row, salted: neither the order of ids nor of texts shows in the mixture.
    docs = docs.withColumn("_vw_row", row_hash(docs, "mix")).drop(*names)
    columns = [c for c in docs.columns if c != "_vw_row"]
    docs = docs.withColumn("_vw_source", F.coalesce(F.col(f"`{source}`"), F.lit("")))
    sizes = {r[0]: r[1] for r in docs.groupBy("_vw_source").count().limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        weights = {s: n ** 0.5 for s, n in sizes.items()}
    if bad := sorted(s for s in sizes if weights.get(s, 0) <= 0):
        raise ValueError(f"sources without a positive weight: {bad[:20]}")
    spark = docs.sparkSession
    dim = _local(spark, [(s, -(-n // PART_ROWS)) for s, n in sizes.items()], ["_vw_source", "_vw_parts"])
    plan = _plan(spark, {s: weights[s] for s in sizes}, {s: -(-n // block) for s, n in sizes.items()})

    dealt = docs.join(dim, "_vw_source").withColumn("_vw_part", F.pmod("_vw_row", "_vw_parts"))
    counts = docs.select("_vw_source", "_vw_row").join(dim, "_vw_source").groupBy("_vw_source", F.pmod("_vw_row", "_vw_parts").alias("_vw_part")).count()
    upto = Window.partitionBy("_vw_source").orderBy("_vw_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_vw_source", "_vw_part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_vw_before"))
    within = Window.partitionBy("_vw_source", "_vw_part").orderBy("_vw_row")
    ranked = dealt.withColumn("_vw_rank", F.row_number().over(within)).join(before, ["_vw_source", "_vw_part"])
    placed = (
        ranked.withColumn("_vw_index", F.col("_vw_before") + F.col("_vw_rank") - 1)
        .withColumn("_vw_block", F.expr(f"_vw_index div {block}"))
        .join(plan, ["_vw_source", "_vw_block"])
    )
    place = F.pmod("_vw_index", F.lit(block)).cast("int")
    return placed.select(
        *[F.col(f"`{c}`") for c in columns], F.col("_vw_block").alias(names[0]), F.col("_vw_slot").alias(names[1]), place.alias(names[2]))


def _local(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of (text, number), of a size that the planner knows."""
    columns = list(zip(*rows)) or [(), ()]
    kinds = [pa.string(), pa.int64()]
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, source: str = "source") -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, by range, so that files written keep it."""
    order = ("_vw_block", "_vw_slot", "_vw_place")
    placed = mix(docs, weights, block, source, order).orderBy(*order[1:])
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns])
