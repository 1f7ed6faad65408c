"""Graph metrics: per posterior draw (map-side on packed rows) and on relational edge lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltweave.operators import kernels
from voltweave.operators.draws import Layout, array_sum, summarise, unfold
from voltweave.runtime import cut

ROWS_PER_STEP = 512


def map_matrices(
    draws: DataFrame, columns: list[str], schema: str, work: Callable[..., list]
) -> DataFrame:
    """Run a batch kernel over packed rows without any shuffle.

    ``work`` gets one (rows, cells) array per column and returns one list per output column.
    """
    out = T.StructType([draws.schema["chain"], draws.schema["draw"], *T._parse_datatype_string(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS_PER_STEP):
                batch = big.slice(at, ROWS_PER_STEP)
                mats = [
                    batch.column(c).flatten().to_numpy(zero_copy_only=False)
                    .reshape(batch.num_rows, -1).astype(float)
                    for c in columns
                ]
                results = [pa.array(r, from_pandas=True) for r in work(*mats)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chain"), batch.column("draw"), *results], names=out.names)

    return draws.select("chain", "draw", *columns).mapInArrow(run, out)


def _lists(x: np.ndarray) -> list:
    return [None if np.isnan(r).all() else r.tolist() for r in x]


def draw_metrics(draws: DataFrame, g: str, n: int, with_betweenness: bool = True) -> DataFrame:
    """Centrality, betweenness (node arrays), transitivity, strong components and acyclicity."""

    def work(cells: np.ndarray) -> list:
        mats = cells.reshape(-1, n, n)
        between = kernels.betweenness(mats) if with_betweenness else np.full((len(mats), n), np.nan)
        return [
            _lists(kernels.centrality(mats)), _lists(between), kernels.transitivity(mats),
            kernels.strong_components(mats).astype(np.int32), kernels.acyclic(mats),
        ]

    schema = "eigen array<double>, between array<double>, transitivity double, n_strong_cc int, acyclic boolean"
    return map_matrices(draws, [g], schema, work)


def in_degrees(g: str, n: int) -> Column:
    """Row sums of a packed matrix: parents of each node."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(
        F.slice(F.col(g), i * n + 1, F.lit(n)), F.lit(0.0), lambda a, v: a + v))


def out_degrees(g: str, n: int) -> Column:
    """Column sums of a packed matrix: children of each node."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(steps, lambda j: F.aggregate(
        steps, F.lit(0.0), lambda a, i: a + F.get(F.col(g), i * n + j)))


def mutual_edges(g: str, n: int) -> Column:
    """Edges whose reverse is present too."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(n * n - 1)), F.lit(0.0), lambda a, k: a + F.get(
        F.col(g), k) * F.get(F.col(g), (k % n) * n + F.floor(k / n).cast("int")))


def degree_metrics(draws: DataFrame, g: str, n: int, n_admissible: int) -> DataFrame:
    """Degrees, density over admissible cells and reciprocity per draw, without a shuffle."""
    edges = array_sum(g)
    return draws.select(
        "chain", "draw",
        in_degrees(g, n).alias("in_degree"), out_degrees(g, n).alias("out_degree"),
        F.zip_with(in_degrees(g, n), out_degrees(g, n), lambda a, b: a + b).alias("total_degree"),
        (edges / F.nullif(F.lit(float(n_admissible)), F.lit(0.0))).alias("density"),
        (mutual_edges(g, n) / F.nullif(edges, F.lit(0.0))).alias("reciprocity"),
    )


def node_summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Posterior mean, median and interval per (metric, node)."""
    named = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in columns])
    long = (
        metrics.select(F.explode(named).alias("_m"))
        .select("_m.metric", F.posexplode("_m.x").alias("node", "value"))
    )
    return summarise(long, ["metric", "node"], "value")


def graph_summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Posterior summary of per-draw scalars; undefined draws are skipped."""
    named = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    long = metrics.select(F.explode(named).alias("_m")).select("_m.metric", "_m.value")
    return summarise(long, ["metric"], "value")


def posterior_edges(draws: DataFrame, g: str, layout: Layout) -> DataFrame:
    """Present edges of every draw as (chain, draw, src = j, dst = i)."""
    return unfold(draws, g, layout).where("value = 1").select(
        "chain", "draw", F.col("j").alias("src"), F.col("i").alias("dst"))


def labelled_edges(pips: DataFrame, keep: Column, labels: DataFrame) -> DataFrame:
    """Selected cells as labelled edges weighted by their probability, self-loops dropped."""
    source = labels.select(F.col("idx").alias("j"), F.col("label").alias("source"))
    target = labels.select(F.col("idx").alias("i"), F.col("label").alias("target"))
    return pips.where(keep & (F.col("i") != F.col("j"))).join(source, "j").join(target, "i").select(
        "source", "target", F.col("mean").alias("weight"))


def weighted_edges(weights: DataFrame, keys: list[str], keep_self: bool = True) -> DataFrame:
    """Positive cells of weight matrices as edges j -> i."""
    edges = weights.where("w > 0")
    return (edges if keep_self else edges.where("i <> j")).select(
        *keys, F.col("j").alias("src"), F.col("i").alias("dst"), F.col("w").alias("weight"))


def reachability(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Node pairs joined by a path, by repeated squaring of the pair relation.

    Every round joins on the middle node and keeps distinct pairs only, so the relation holds at
    most n^2 rows per graph and path length doubles per round.
    """
    pairs = cut(edges.select(*keys, "src", "dst").distinct())
    size = pairs.count()
    while True:
        left = pairs.withColumnRenamed("dst", "_mid")
        right = pairs.withColumnRenamed("src", "_mid")
        longer = left.join(right, [*keys, "_mid"]).select(*keys, "src", "dst")
        pairs = cut(pairs.unionByName(longer).distinct())
        grown = pairs.count()
        if grown == size:
            return pairs
        size = grown


def is_dag(edges: DataFrame) -> bool:
    """True when no node reaches itself."""
    return reachability(edges, []).where("src = dst").isEmpty()


def component_count(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Strongly connected components of one graph: nodes that are the least of their component."""
    r = reachability(edges, [])
    back = r.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    smaller = r.join(back, ["src", "dst"]).where("dst < src").select(F.col("src").alias("node")).distinct()
    return nodes.select("node").join(smaller, "node", "left_anti").agg(F.count("*").alias("n_strong_cc"))
