"""Chat formatting with minimum-cost role repair.

A legal conversation is what the turn automaton accepts: a system turn or none, then user and assistant
in turns, the assistant last. Dynamic programming over its states finds the cheapest way to make a
conversation legal: merge a turn into the one before, relabel it, or insert empty turns. The repaired
sequence is rendered piece by piece, one for each row, so that the pieces of a conversation in order of
``position`` are its text and no conversation, however long, has to come together.

Long conversations are cut into blocks. A block is summed up by its (min, +) matrix from the role before
it to its last role; the matrices of a conversation give every block the true costs before it. With these a block
tells which role stands before it for each role at its end, and these maps, put together from the end, fix
the roles at the cuts. So the repair is that of one block, ties included: of all cheapest ones that with
the first role (in order of ROLES) at the last row, then at the row before, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.runtime import cut

ROLES = ["system", "user", "assistant"]
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Legal next roles of the automaton; a conversation may end behind those in ACCEPT.
NEXT = {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}
ACCEPT = ["assistant"]
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 3, 1, 2
BLOCK = 4096
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"

_START = len(ROLES)
_FAR = 1 << 40


def _paths() -> dict[tuple[int, int], list[int]]:
    """Empty turns to insert between two roles (or before the first), the fewest, in order of ROLES on ties."""
    index = {r: k for k, r in enumerate([*ROLES, ""])}
    out = {}
    for name, source in index.items():
        reach = [([], index[name])]
        seen = set()
        while reach:
            inserted, at = reach.pop(0)
            for r in sorted(index[x] for x in NEXT[[*ROLES, ""][at]]):
                out.setdefault((source, r), inserted)
                if r not in seen:
                    seen.add(r)
                    reach.append(([*inserted, r], r))
    return out


PATHS = _paths()
#: Empty turns behind the last role.
ENDS = {r: [] if ROLES[r] in ACCEPT else min(
    ([*PATHS[(r, a)], a] for a in map(ROLES.index, ACCEPT) if (r, a) in PATHS), key=len) for r in range(len(ROLES))}


def _step(before: int, role: int) -> int:
    """Cost of a role behind another: a merge, or the turns to insert."""
    if before == role:
        return MERGE
    return INSERT * len(PATHS[(before, role)]) if (before, role) in PATHS else _FAR


STEP = [[_step(s, r) for r in range(len(ROLES))] for s in range(len(ROLES) + 1)]
END = [INSERT * len(ENDS[r]) for r in range(len(ROLES))]


def _label(code: int, role: int) -> int:
    """Cost of a role for a row: ``code`` is its own role, or -1 for one the automaton doesn't know."""
    return 0 if code == role else RELABEL_UNKNOWN if code < 0 else RELABEL


LABEL = {code: [_label(code, r) for r in range(len(ROLES))] for code in range(-1, len(ROLES))}


def matrix(codes: list[int]) -> list[list[int]]:
    """Cheapest cost from each role before a block (START last) to each role at its end."""
    out = []
    for s in range(len(ROLES) + 1):
        cost = [STEP[s][r] + LABEL[codes[0]][r] for r in range(len(ROLES))]
        for code in codes[1:]:
            label = LABEL[code]
            cost = [min(cost[p] + STEP[p][r] for p in range(len(ROLES))) + label[r] for r in range(len(ROLES))]
        out.append(cost)
    return out


def prefixes(matrices: list[list[list[int]]]) -> list[list[int]]:
    """For each block and behind the last one the cheapest cost of each role (START last) that may stand there."""
    out = [[_FAR] * len(ROLES) + [0]]
    for m in matrices:
        cost = out[-1]
        out.append([min(cost[p] + m[p][r] for p in range(len(ROLES) + 1)) for r in range(len(ROLES))] + [_FAR])
    return out


def _back(codes: list[int], before: list[int]) -> list[list[int]]:
    """For each row and role the role before it on the cheapest way, the first one on ties."""
    cost, back = before, []
    for code in codes:
        ways = [[c + STEP[p][r] for p, c in enumerate(cost)] for r in range(len(ROLES))]
        back.append([w.index(min(w)) for w in ways])
        cost = [min(w) + LABEL[code][r] for r, w in enumerate(ways)]
    return back


def traced(codes: list[int], before: list[int]) -> list[int]:
    """For each last role of a block the role before the block; ``before`` are the costs there."""
    at = list(range(len(ROLES)))
    for b in reversed(_back(codes, before)):
        at = [b[r] for r in at]
    return at


def cuts(maps: list[list[int]], behind: list[int]) -> list[int]:
    """The last role of every block, from the blocks' maps and the costs behind the last one."""
    total = [c + e for c, e in zip(behind, END)]
    out = [total.index(min(total))]
    for m in reversed(maps[1:]):
        out.append(m[out[-1]])
    return out[::-1]


def resolve(codes: list[int], before: list[int], last: int) -> list[int]:
    """Roles of the rows of a block with the costs before it and its last role; before them the role it stands behind."""
    out = [last]
    for b in reversed(_back(codes, before)):
        out.append(b[out[-1]])
    return out[::-1]


def _empty(role: int) -> str:
    return OPEN.format(ROLES[role]) + CLOSE


def _before(before: int, role: int) -> str:
    """What stands before the text of a row."""
    if before == role:
        return JOIN
    return ("" if before == _START else CLOSE) + "".join(map(_empty, PATHS[(before, role)])) + OPEN.format(ROLES[role])


BEFORE = {(s, r): _before(s, r) for s in range(len(ROLES) + 1) for r in range(len(ROLES)) if STEP[s][r] < _FAR}
AFTER = [CLOSE + "".join(map(_empty, ENDS[r])) for r in range(len(ROLES))]


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with ``position`` in the conversation and ``code`` of the role, written.

    Rows are dealt by range, so a long conversation lies in several tasks; each counts its own rows and
    the counts before it are added.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    name = F.lower(F.trim("role"))
    code = F.lit(-1)
    for role, own in [*ALIASES.items(), *((r, r) for r in ROLES)]:
        code = F.when(name == role, ROLES.index(own)).otherwise(code)
    rows = cut(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("code", code))
    part = F.shiftright("_at", 33)
    parts = rows.groupBy("conv_id", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    many = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_part", "_first", "_n"))).alias("_parts"))
    spread = many.select("conv_id", F.posexplode("_parts").alias("_k", "_p"), "_parts").select(
        F.col("conv_id").alias("_conv"), F.col("_p._part").alias("_part"), F.col("_p._first").alias("_first"),
        F.aggregate(F.slice("_parts", F.lit(1), F.col("_k")), F.lit(0).cast("long"), lambda a, x: a + x["_n"]).alias("_offset"))
    joined = rows.join(spread, (part == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    return cut(joined.select(*order, "code", (F.col("_at") - F.col("_first") + F.col("_offset")).alias("position")))


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id, position, turn, role, new_role, edit, rendered`` for every row of ``turns``.

    Rows go by turn (NULL first), then role and text. ``edit`` is keep, relabel or merge (into the turn
    before; a merged row may be relabelled as well), with +insert if empty turns stand before it.
    Unknown and NULL roles are relabelled, NULL texts are empty, repeated rows are turns of their own,
    rows without conv_id are one conversation. Other columns are left out; an empty table stays empty.
    """
    rows = numbered(turns)
    block = F.floor(F.col("position") / BLOCK).alias("block")
    blocks = cut(rows.groupBy("conv_id", block).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "code"))), lambda x: x["code"]).alias("codes")))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [sum(matrix(c), []) for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array(sums, pa.list_(pa.int64()))], ["conv_id", "block", "m"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    sums = blocks.mapInArrow(sum_up, f"conv_id {kind}, block long, m array<long>")
    ways = sums.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("blocks"))
    n = len(ROLES)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Costs before every block, and behind a conversation's last one."""
        for batch in batches:
            conv, places, costs, behind = [], [], [], []
            for c, found in zip(batch.column("conv_id").to_pylist(), batch.column("blocks").to_pylist()):
                known = prefixes([[b["m"][k: k + n] for k in range(0, n * n + n, n)] for b in found])
                conv += [c] * len(found)
                places += [b["block"] for b in found]
                costs += known[:-1]
                behind += [None] * (len(found) - 1) + [known[-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, batch.schema.field("conv_id").type), pa.array(places, pa.int64()),
                 pa.array(costs, pa.list_(pa.int64())), pa.array(behind, pa.list_(pa.int64()))], ["_conv", "_block", "before", "behind"])

    weighed = ways.mapInArrow(weigh, f"_conv {kind}, _block long, before array<long>, behind array<long>")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    # Written: its costs are read twice.
    blocks = cut(blocks.join(weighed, same).select("conv_id", "block", "codes", "before", "behind"))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [traced(c, b) for c, b in zip(batch.column("codes").to_pylist(), batch.column("before").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), batch.column("behind"), pa.array(maps, pa.list_(pa.int64()))],
                ["conv_id", "block", "behind", "map"])

    maps = blocks.mapInArrow(trace, f"conv_id {kind}, block long, behind array<long>, map array<long>")
    maps = maps.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "map", "behind"))).alias("blocks"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, places, last = [], [], []
            for c, found in zip(batch.column("conv_id").to_pylist(), batch.column("blocks").to_pylist()):
                conv += [c] * len(found)
                places += [b["block"] for b in found]
                last += cuts([b["map"] for b in found], found[-1]["behind"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, batch.schema.field("conv_id").type), pa.array(places, pa.int64()), pa.array(last, pa.int32())], ["_conv", "_block", "last"])

    decided = maps.mapInArrow(decide, f"_conv {kind}, _block long, last int")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, place, role, head, tail, edit = [], [], [], [], [], []
            for r in batch.to_pylist():
                before, *roles = resolve(r["codes"], r["before"], r["last"])
                for k, (code, new) in enumerate(zip(r["codes"], roles)):
                    conv.append(r["conv_id"])
                    place.append(r["block"] * BLOCK + k)
                    role.append(ROLES[new])
                    head.append(BEFORE[(before, new)])
                    tail.append("")
                    inserts = before != new and PATHS[(before, new)]
                    edit.append(("merge" if before == new else "keep" if code == new else "relabel") + ("+insert" if inserts else ""))
                    before = new
                if r["behind"] is not None:
                    tail[-1] = AFTER[before]
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, batch.schema.field("conv_id").type), pa.array(place, pa.int64()),
                 *[pa.array(x, pa.string()) for x in (role, head, tail, edit)]], ["_conv", "_place", "new_role", "_head", "_tail", "edit"])

    settled = blocks.join(decided, same).select("conv_id", "block", "codes", "before", "behind", "last").mapInArrow(
        settle, f"_conv {kind}, _place long, new_role string, _head string, _tail string, edit string")
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("position") == F.col("_place"))
    return rows.join(settled, here).select(
        "conv_id", "position", "turn", "role", "new_role", "edit",
        F.concat("_head", F.coalesce("text", F.lit("")), "_tail").alias("rendered"))
