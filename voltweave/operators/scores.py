"""Marginal likelihoods of blocks, local scores of any parent set, gains of every toggle, reduced forms.

A matrix of the model (cross products plus prior scale) has one row and column per design variable, so its size is
that of the model, not of the data; it is collected once (``matrix_of``) and reaches the tasks with the code. What grows with the data
are the parent sets of draws: different ones are scored once and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltweave.operators.bayes import BlockScore

#: Variables of a model whose matrix is collected: 3000 x 3000 cells are 72 MB.
MAX_WIDTH = 3000
#: Matrix cells worked on at once in a task.
CELLS = 4_000_000


def matrix_of(cells: DataFrame, width: int) -> np.ndarray:
    """The matrix of cell rows (a, b, s); absent cells are 0."""
    if width > MAX_WIDTH:
        raise ValueError(f"{width} variables; {MAX_WIDTH} at most")
    found = cells.select("a", "b", "s").toArrow()
    out = np.zeros((width, width))
    out[found["a"].to_numpy(), found["b"].to_numpy()] = found["s"].to_numpy()
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.array(v, np.int64) for v in column.to_pylist()]


def _padded(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of one width; -1 stands behind shorter sets."""
    out = np.full((len(sets), max(map(len, sets), default=0)), -1, np.int64)
    for row, s in zip(out, sets):
        row[: len(s)] = s
    return out


def masked_log_determinants(matrix: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Log determinant of each principal block (rows of indices, -1 is none), by one batched Cholesky factor.

    Rows and columns behind the end of a smaller block are those of the unit matrix, which leaves its determinant.
    """
    there = blocks >= 0
    both = there[:, :, None] & there[:, None, :]
    at = np.where(there, blocks, 0)
    stack = np.where(both, matrix[at[:, :, None], at[:, None, :]], np.eye(blocks.shape[1]))
    factor = np.linalg.cholesky(stack) if blocks.shape[1] else stack
    return 2 * np.log(np.einsum("bii->bi", factor)).sum(axis=1)


def block_marginals(blocks: DataFrame, post: np.ndarray, score: BlockScore, block: str = "block") -> DataFrame:
    """``log_marginal`` of each row's block of variables (array of ints, none of them twice); an empty block has 0."""
    schema = T.StructType([*blocks.schema.fields, T.StructField("log_marginal", T.DoubleType())])
    half = (score.alpha + score.t_obs) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _lists(batch.column(block))
            offsets = {n: score.offset(n) for n in {len(s) for s in sets}}
            found = np.empty(len(sets))
            widest = max(map(len, sets), default=0)
            step = max(1, CELLS // max(widest * widest, 1))
            for k in range(0, len(sets), step):
                part = sets[k: k + step]
                found[k: k + step] = [offsets[len(s)] for s in part] - half * masked_log_determinants(post, _padded(part))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=schema.names)

    return blocks.mapInArrow(run, schema)


def parent_sets(draws: DataFrame, g: str, n: int) -> DataFrame:
    """``chain, draw, node, parents``: the other nodes with an edge into each node (row = driven node), ascending."""

    def parents(i):
        cell = lambda j: F.get(F.col(g), (i * n + j).cast("int"))
        return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (j != i) & (cell(j) != 0))

    nodes = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("node"), parents(i).alias("parents")))
    return draws.select("chain", "draw", F.inline(nodes))


def local_scores(sets: DataFrame, post: np.ndarray, score: BlockScore) -> DataFrame:
    """``score`` of every row's node given its parents: log marginal of both less that of the parents.

    Blocks that many draws share are factored once.
    """
    family = F.array_sort(F.array_append("parents", F.col("node")))
    rows = sets.withColumn("_family", family)
    blocks = rows.select(F.explode(F.array("_family", "parents")).alias("block")).distinct()
    found = block_marginals(blocks, post, score)
    of = lambda name: found.select(F.col("block").alias(name), F.col("log_marginal").alias(f"_of{name}"))
    return rows.join(of("_family"), "_family").join(of("parents"), "parents").select(
        *sets.columns, (F.col("_of_family") - F.col("_ofparents")).alias("score"))


def swept(matrix: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """The matrix swept on every set (rows of indices, -1 is none).

    Behind it the set's own block is minus its inverse, the cells beside it are regression coefficients on the set, and
    all others are what the set leaves unexplained.
    """
    out = np.repeat(matrix[None], len(sets), axis=0)
    for pivots in sets.T:
        b = np.flatnonzero(pivots >= 0)
        k = pivots[b]
        row, d = out[b, k, :], out[b, k, k]
        part = out[b] - row[:, :, None] * row[:, None, :] / d[:, None, None]
        part[np.arange(len(b)), k, :] = part[np.arange(len(b)), :, k] = row / d[:, None]
        part[np.arange(len(b)), k, k] = -1 / d
        out[b] = part
    return out


def toggle_gains(
    sets: DataFrame, post: np.ndarray, score: BlockScore, columns: range, response: str = "response", parents: str = "parents"
) -> DataFrame:
    """``column, gain`` for every column in ``columns`` beside the row's other fields: what the local score gains when the
    column leaves the row's parents or joins them. The response itself gives no row.

    One sweep on the parents holds the remaining variance of the response and of every candidate, and with them all gains at once.
    """
    schema = T.StructType([*sets.schema.fields, T.StructField("column", T.ArrayType(T.IntegerType())), T.StructField("gain", T.ArrayType(T.DoubleType()))])
    half, width, wanted = (score.alpha + score.t_obs) / 2, len(post), np.arange(columns.start, columns.stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains = []
            step = max(1, CELLS // (width * width))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                gains += list(_gains(part.column(response).to_numpy(), _padded(_lists(part.column(parents)))))
            keep = [wanted != r for r in batch.column(response).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([wanted[k].astype(np.int32) for k in keep], pa.list_(pa.int32())),
                 pa.array([g[k] for g, k in zip(gains, keep)], pa.list_(pa.float64()))], names=schema.names)

    def _gains(i: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        s, rows = swept(post, chosen), np.arange(len(i))
        left, beside, own = s[rows, i, i], s[rows, i, :], np.einsum("bkk->bk", s)
        # A parent's diagonal cell is minus that of the inverse, so one formula serves for both ways.
        with np.errstate(invalid="ignore", divide="ignore"):
            fit = np.log(left[:, None] - beside ** 2 / own) - np.log(left)[:, None]
        n = (chosen >= 0).sum(axis=1)
        inside = np.zeros((len(i), width), bool)
        at = np.nonzero(chosen >= 0)
        inside[at[0], chosen[at]] = True
        offset = np.array([score.offset(k) for k in range(chosen.shape[1] + 3)])
        local = np.diff(offset)  # by number of parents
        change = np.where(inside, local[np.maximum(n - 1, 0)][:, None], local[n + 1][:, None]) - local[n][:, None]
        return (change - half * fit)[:, wanted]

    found = sets.mapInArrow(run, schema)
    return found.select(*sets.columns, F.inline(F.arrays_zip("column", "gain")))


def structural(sets: DataFrame, sigma: np.ndarray) -> DataFrame:
    """``coefs`` of each row's node on its parents (in their order) and the ``variance`` left, as a covariance implies them.

    A covariance that is singular on the parents gives values that aren't finite.
    """
    schema = T.StructType([*sets.schema.fields, T.StructField("coefs", T.ArrayType(T.DoubleType())), T.StructField("variance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coefs, variances = [], []
            step = max(1, CELLS // len(sigma) ** 2)
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                i, parents = part.column("node").to_numpy(), _lists(part.column("parents"))
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = swept(sigma, _padded(parents))
                coefs += [s[row, node, p] for row, (node, p) in enumerate(zip(i, parents))]
                variances.append(s[np.arange(len(i)), i, i])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(coefs, pa.list_(pa.float64())), pa.array(np.concatenate([np.zeros(0), *variances]))], names=schema.names)

    return sets.mapInArrow(run, schema)


def topological(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For graphs (batch, driven, driver): orders in which drivers stand before what they drive (the smallest
    ready node first), and which graphs have one."""
    b, n, _ = g.shape
    missing = (g != 0).sum(axis=2)
    order, whole = np.zeros((b, n), np.int64), np.ones(b, bool)
    rows = np.arange(b)
    for k in range(n):
        ready = missing == 0
        node = ready.argmax(axis=1)
        whole &= ready[rows, node]
        order[:, k] = node
        missing -= (g[rows, :, node] != 0)
        missing[rows, node] = n * n  # placed
    return order, whole


def reduced_form(now: np.ndarray, lagged: np.ndarray) -> np.ndarray:
    """(I - now)^-1 lagged for every draw: ``now`` (draws, n, n) are the contemporaneous coefficients, 0 without an
    edge, ``lagged`` (draws, n, m) those of all lags side by side.

    Graphs without a cycle by forward substitution in their topological order; others by elimination, and a draw
    whose system is singular keeps its coefficients as they are.
    """
    order, whole = topological(now)
    out = lagged.copy()
    rows = np.flatnonzero(whole)
    for k in range(now.shape[1]):
        node = order[rows, k]
        # The nodes that drive this one are final; the others have coefficient 0.
        out[rows, node] += np.einsum("bj,bjm->bm", now[rows, node], out[rows])
    for r in np.flatnonzero(~whole):
        system = np.eye(now.shape[1]) - now[r]
        if np.linalg.matrix_rank(system) == len(system):
            out[r] = np.linalg.solve(system, lagged[r])
    return out
