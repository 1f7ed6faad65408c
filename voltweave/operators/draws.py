"""Posterior draws: one row per (chain, draw) with the tensor of that draw packed in an array.

Keeping a draw in one row makes every per-draw quantity a map-side expression, while quantities
per cell unfold the array and combine before the shuffle (cells are few, draws are many).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltweave.operators.quantiles import exact_quantiles

CREDIBLE = {"median": 0.5, "ci_low": 0.05, "ci_high": 0.95}


@dataclass(frozen=True)
class Layout:
    """Order of the packed cells: lag-major, then response row i, then driver column j."""

    rows: int
    cols: int
    lags: list[int] = field(default_factory=lambda: [0])

    @property
    def slice_size(self) -> int:
        return self.rows * self.cols

    def locate(self, df: DataFrame, cell: str = "cell") -> DataFrame:
        """Add lag, i, j of a cell index."""
        c = F.col(cell)
        lags = F.array(*[F.lit(v) for v in self.lags])
        return df.withColumns({
            "lag": F.get(lags, F.floor(c / self.slice_size).cast("int")),
            "i": F.floor((c % self.slice_size) / self.cols).cast("int"),
            "j": (c % self.cols).cast("int"),
        })

    def lag_slice(self, x: str, lag: int) -> Column:
        return F.slice(x, self.lags.index(lag) * self.slice_size + 1, self.slice_size)

    def column_part(self, x: str, wanted: list[int]) -> Column:
        """Cells whose driver column is in the list."""
        cols = F.array(*[F.lit(int(j)) for j in wanted])
        return F.filter(x, lambda v, k: F.array_contains(cols, (k % self.cols).cast("int")))


def array_sum(x: Column | str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def norm(x: Column | str) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def largest(x: Column | str) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def trace(x: str, n: int) -> Column:
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0),
        lambda a, k: a + F.get(F.col(x), (k * (n + 1)).cast("int")))


def indicator(x: str, above: float = 0.0) -> Column:
    return F.transform(x, lambda v: F.when(v > above, 1.0).otherwise(0.0))


def masked(g: str, x: str) -> Column:
    """Coefficients where their edge is present, else 0."""
    return F.zip_with(g, x, lambda a, b: a * b)


def unfold(draws: DataFrame, x: str, layout: Layout | None = None) -> DataFrame:
    """Long form: one row per cell of every draw."""
    long = draws.select("chain", "draw", F.posexplode(x).alias("cell", "value"))
    return layout.locate(long) if layout else long


def check_chains(draws: DataFrame, n_chains: int, uneven: bool = False) -> int:
    """Draws per chain (of the longest); an error when a chain is absent or, unless ``uneven``, the chains differ in length."""
    counts = {r.chain: r.n for r in draws.groupBy("chain").agg(F.count("*").alias("n")).collect()}
    missing = [c for c in range(n_chains) if c not in counts]
    if missing:
        raise FileNotFoundError(f"chains without draws: {missing}")
    if not uneven and len(set(counts.values())) != 1:
        raise ValueError(f"chains differ in length: {counts}")
    return max(counts.values())


def chain_lengths(draws: DataFrame, n_chains: int) -> list[int]:
    """Draws of every chain, 0 for an absent one."""
    counts = {r.chain: r.n for r in draws.groupBy("chain").agg(F.count("*").alias("n")).collect()}
    return [counts.get(c, 0) for c in range(n_chains)]


def pooled(draws: DataFrame, n_keep: int | Sequence[int]) -> DataFrame:
    """Chain-major position of a draw in the pooled sample.

    ``n_keep`` is the number of draws of a chain, or one number for each chain where they differ: a chain
    starts where the one before it ends, so no position is used twice or left out.
    """
    if isinstance(n_keep, int):
        return draws.withColumn("pos", F.col("chain") * F.lit(n_keep) + F.col("draw"))
    starts = F.array(*[F.lit(n).cast("long") for n in accumulate([0, *n_keep])])
    return draws.withColumn("pos", F.get(starts, F.col("chain")) + F.col("draw"))


def thinned(draws: DataFrame, step: int) -> DataFrame:
    return draws.where(F.col("draw") % step == 0)


def cell_average(draws: DataFrame, x: str, layout: Layout) -> DataFrame:
    """Posterior mean per cell (an inclusion probability when x is 0/1)."""
    long = draws.select(F.posexplode(x).alias("cell", "value"))
    return layout.locate(long.groupBy("cell").agg(F.avg("value").alias("mean")))


def cell_summary(draws: DataFrame, x: str, layout: Layout) -> DataFrame:
    """Posterior mean, median and 90 % interval per cell."""
    long = draws.select(F.posexplode(x).alias("cell", "value"))
    return layout.locate(summarise(long, ["cell"], "value"))


def summarise(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, 5 % and 95 % quantile per group; NULL (undefined) values are skipped."""
    return exact_quantiles(long, keys, value, CREDIBLE, "mean", empty=True)


def scalars_long(df: DataFrame, names: list[str]) -> DataFrame:
    """Wide per-draw scalars as rows (chain, draw, name, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select("chain", "draw", F.explode(pairs).alias("_p")).select(
        "chain", "draw", "_p.name", "_p.value")


def graph_scalars(draws: DataFrame, g: str, layout: Layout, prefix: str) -> DataFrame:
    """Active edges in all and per lag, per draw."""
    cols = {f"{prefix}_active": array_sum(g)}
    if len(layout.lags) > 1:
        cols |= {f"{prefix}_lag{k}": array_sum(layout.lag_slice(g, k)) for k in layout.lags}
    return draws.withColumns(cols)


def coefficient_scalars(draws: DataFrame, x: str, prefix: str) -> DataFrame:
    """Overall norm and largest absolute coefficient, per draw."""
    return draws.withColumns({f"{prefix}_norm": norm(x), f"{prefix}_max": largest(x)})


def driver_scalars(
    draws: DataFrame, x: str, g: str, layout: Layout, types: dict[str, list[int]], prefix: str
) -> DataFrame:
    """Norm, largest coefficient and active edges by driver type (columns from the exog dimension)."""
    cols: dict[str, Column] = {}
    for kind, columns in types.items():
        part = layout.column_part(x, columns)
        cols[f"{prefix}_{kind}_norm"] = norm(part)
        cols[f"{prefix}_{kind}_max"] = largest(part)
        cols[f"{prefix}_{kind}_active"] = array_sum(layout.column_part(g, columns))
    return draws.withColumns(cols)
