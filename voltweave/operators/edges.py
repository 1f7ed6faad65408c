"""Edge probabilities, credible edge sets and threshold tables. Cells are (lag, i, j): j drives i."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltweave.functions.columns import credible_lower
from voltweave.operators.diagnostics import ess_initial_positive
from voltweave.operators.draws import Layout, cell_average, pooled


def edge_table(
    draws: DataFrame, g: str, layout: Layout, n_keep: int | Sequence[int], n_chains: int,
    admissible: str = "true", alpha: float = 0.10, max_lag: int = 100,
) -> DataFrame:
    """One row per cell with edge probability, ESS, lower bound and both selections.

    ``admissible`` is a SQL condition on (i, j); other cells get probability 0 and no ESS. ``n_keep`` is as in ``pooled``.
    """
    n = n_keep * n_chains if isinstance(n_keep, int) else sum(n_keep)
    pips = cell_average(draws, g, layout)
    ess = ess_initial_positive(pooled(draws, n_keep), g, n, max_lag)
    table = pips.join(ess, "cell").withColumn("admissible", F.expr(admissible))
    table = table.withColumns({
        "edge_prob": F.when(F.col("admissible"), F.col("mean")).otherwise(0.0),
        "n_eff": F.when(F.col("admissible"), F.col("n_eff")),
    })
    bound = F.when(F.col("admissible"), credible_lower(F.col("edge_prob"), F.col("n_eff"), alpha)).otherwise(0.0)
    return select_edges(table.withColumn("ci_lower", bound)).drop("mean", "cell")


def select_edges(table: DataFrame) -> DataFrame:
    """Naive (probability above 1/2) and credible (lower bound above 1/2) selections."""
    return table.withColumns({
        "selected_naive": (F.col("edge_prob") > 0.5) & F.col("admissible"),
        "selected_credible": (F.col("ci_lower") > 0.5) & F.col("admissible"),
    })


def slice_counts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Admissible and selected edges with their densities per graph slice."""
    counts = edges.groupBy(*keys).agg(
        F.count_if("admissible").alias("n_admissible"),
        F.count_if("selected_naive").alias("n_naive"),
        F.count_if("selected_credible").alias("n_credible"))
    base = F.nullif("n_admissible", F.lit(0))
    return counts.withColumns({
        "density_naive": F.col("n_naive") / base, "density_credible": F.col("n_credible") / base})


def top_edges(edges: DataFrame, keys: list[str], n_cols: int, k: int = 10) -> DataFrame:
    """The k most probable admissible edges per slice; ties go to the higher flat cell index."""
    flat = F.col("i") * n_cols + F.col("j")
    w = Window.partitionBy(*keys).orderBy(F.desc("edge_prob"), F.desc(flat))
    return edges.where("admissible").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def threshold_counts(pips: DataFrame, thresholds: list[float]) -> DataFrame:
    """Edges above each probability threshold per graph and lag, with the total over lags."""
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    return (
        pips.withColumn("threshold", F.explode(levels))
        .withColumn("lag_label", F.explode(F.array(F.concat(F.lit("lag"), F.col("lag")), F.lit("total"))))
        .groupBy("threshold", "graph", "lag_label")
        .agg(F.count_if(F.col("mean") > F.col("threshold")).alias("edges"))
    )


def weight_distribution(means: DataFrame, square: bool) -> DataFrame:
    """Spread of |posterior mean| per lag (off the diagonal when the block is square).

    The rows are the cells of one coefficient block, so the quantiles are over a bounded group.
    """
    w = F.abs("mean")
    off = means.where("i <> j") if square else means
    return off.groupBy("lag").agg(
        F.count("*").alias("n_cells"), F.max(w).alias("max_w"), F.avg(w).alias("mean_w"),
        F.median(w).alias("median_w"), F.percentile(w, 0.90).alias("q90"),
        F.percentile(w, 0.95).alias("q95"), F.percentile(w, 0.99).alias("q99"))


def weight_thresholds(means: DataFrame, thresholds: list[float], square: bool) -> DataFrame:
    """Cells kept and density at each weight threshold per lag."""
    off = means.where("i <> j") if square else means
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    kept = off.withColumn("threshold", F.explode(levels)).groupBy("lag", "threshold").agg(
        F.count_if(F.abs("mean") > F.col("threshold")).alias("n_kept"), F.count("*").alias("_n"))
    return kept.withColumn("density", F.col("n_kept") / F.col("_n")).drop("_n")
