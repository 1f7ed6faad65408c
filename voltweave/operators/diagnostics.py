"""Convergence diagnostics of packed draws. ``x`` is an array of quantities per (chain, draw)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltweave.functions.columns import bernoulli_kl
from voltweave.operators.series import (
    autocovariance_sums, centred, lag_products, monotone_tau,
)
from voltweave.operators.spectra import all_autocovariance_sums
from voltweave.runtime import cut


def chain_moments(draws: DataFrame, x: str) -> DataFrame:
    """Mean, sample variance and length per chain and cell."""
    long = draws.select("chain", F.posexplode(x).alias("cell", "value"))
    return long.groupBy("chain", "cell").agg(
        F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.count("*").alias("n"))


def between_within(draws: DataFrame, x: str) -> DataFrame:
    """Per cell: chains m, draws n, within variance W, between variance B and their mix."""
    table = chain_moments(draws, x).groupBy("cell").agg(
        F.count("*").alias("m"), F.max("n").alias("n"),
        (F.max("n") * F.var_samp("mean")).alias("b"), F.avg("var").alias("w"))
    mixed = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b") / F.col("n")
    return table.withColumn("var_hat", mixed)


def rhat(draws: DataFrame, x: str) -> DataFrame:
    """Potential scale reduction per cell: 1 for constants, NULL for <2 chains or <4 draws."""
    enough = (F.col("m") >= 2) & (F.col("n") >= 4)
    value = F.when(F.col("w") == 0, 1.0).otherwise(F.sqrt(F.col("var_hat") / F.nullif("w", F.lit(0.0))))
    return between_within(draws, x).select("cell", F.when(enough, value).alias("rhat"))


def autocorrelations(pooled: DataFrame, x: str, max_lag: int) -> DataFrame:
    """Autocorrelation of the pooled series per cell and lag, products averaged over n - lag.

    A (nearly) constant cell has autocorrelation 0.
    """
    sums = autocovariance_sums(pooled, [], "pos", x, max_lag)
    zero = sums.where("lag = 0").select("cell", (F.col("s") / F.col("n")).alias("_var"))
    rho = F.when(F.col("_var") < 1e-12, 0.0).otherwise(
        F.col("s") / (F.col("n") - F.col("lag")) / F.nullif("_var", F.lit(0.0)))
    return sums.join(zero, "cell").select("cell", "lag", "n", rho.alias("rho"))


def autocovariances(draws: DataFrame, x: str, max_lag: int | None = None) -> DataFrame:
    """Autocovariance per chain, cell and lag, divided by n; all lags (by Fourier transform) unless a largest one is given."""
    if max_lag is None:
        sums = all_autocovariance_sums(draws, ["chain"], "draw", x)
    else:
        sums = autocovariance_sums(draws, ["chain"], "draw", x, max_lag)
    return sums.select("chain", "cell", "lag", (F.col("s") / F.col("n")).alias("acov"))


def _positive_sum(rho: Column) -> Column:
    """Sum of the leading positive values of an ordered array."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(True).alias("live"))

    def step(acc, r):
        live = acc["live"] & (r > 0)
        return F.struct(
            F.when(live, acc["total"] + r).otherwise(acc["total"]).alias("total"), live.alias("live"))

    return F.aggregate(rho, start, step, lambda a: a["total"])


def _initial_positive(rho: DataFrame) -> DataFrame:
    """Per cell: length and the sum of autocorrelations before the first non-positive one."""
    return (
        rho.groupBy("cell", "n")
        .agg(F.sort_array(F.collect_list(F.struct("lag", "rho"))).alias("_r"))
        .select("cell", "n", _positive_sum(F.transform(
            F.filter("_r", lambda r: r["lag"] > 0), lambda r: r["rho"])).alias("_sum"))
    )


def ess_initial_positive(pooled: DataFrame, x: str, n: int, max_lag: int = 100) -> DataFrame:
    """ESS over the pooled series: lags up to min(max_lag, n // 4), never above n."""
    longest = min(max_lag, n // 4)
    rho = autocorrelations(pooled, x, max(longest, 0))
    ess = F.least(F.col("n") / (1.0 + 2.0 * F.col("_sum")), F.col("n").cast("double"))
    return _initial_positive(rho).select("cell", ess.alias("n_eff"))


def ess_biased(pooled: DataFrame, x: str, n: int, max_lag: int = 1000) -> DataFrame:
    """ESS with autocorrelation sums over the total sum of squares and no upper bound."""
    sums = autocovariance_sums(pooled, [], "pos", x, min(max_lag, n - 1))
    zero = sums.where("lag = 0").select("cell", F.col("s").alias("_s0"))
    rho = sums.join(zero, "cell").select(
        "cell", "lag", "n", F.coalesce(F.col("s") / F.nullif("_s0", F.lit(0.0)), F.lit(0.0)).alias("rho"))
    return _initial_positive(rho).select(
        "cell", (F.col("n") / (1.0 + 2.0 * F.col("_sum"))).alias("n_eff"))


def ess_geyer(series: DataFrame, keys: list[str], pos: str, x: str) -> DataFrame:
    """Initial-monotone-sequence ESS per series and cell: ``keys, cell, n, mean, var, ess``."""
    long = series.select(*keys, F.posexplode(x).alias("cell", "value"))
    stats = long.groupBy(*keys, "cell").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"),
        F.var_samp("value").alias("var"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    stats = cut(stats)
    longest = stats.agg(F.max("n")).first()[0] or 0
    even = centred(series, keys, x)
    zero = (
        even.select(*keys, F.posexplode(x).alias("cell", "value"))
        .groupBy(*keys, "cell").agg(F.sum(F.col("value") ** 2).alias("_s0"), F.count("*").alias("n"))
    )

    def rho_at(lo: int, hi: int) -> DataFrame:
        return lag_products(even, keys, pos, x, lo, hi).join(zero, [*keys, "cell"]).select(
            *keys, "cell", "n", "lag", (F.col("s") / F.nullif("_s0", F.lit(0.0))).alias("rho"))

    taus = monotone_tau(rho_at, [*keys, "cell"], longest)
    flat = (F.col("n") < 4) | (F.col("_lo") == F.col("_hi"))
    ess = F.when(flat | F.col("tau").isNull(), F.col("n").cast("double")).otherwise(F.col("n") / F.col("tau"))
    return stats.join(taus, [*keys, "cell"], "left").select(
        *keys, "cell", "n", "mean", "var", ess.alias("ess"))


def ess_multichain(draws: DataFrame, x: str) -> DataFrame:
    """Combined ESS per cell: within-chain autocovariances averaged over chains and scaled by the
    mixed variance, so chains that disagree count for less. A chain's autocovariances are divided by its own length;
    n is the length of the longest one.

    Cells whose chains never move give m * n, and leave before any lag is computed. Fewer than two
    chains or four draws are one series, chain after chain.
    """
    mix = cut(between_within(draws, x))
    shape = mix.agg(F.max("m").alias("m"), F.max("n").alias("n")).first()
    if shape.m is None:
        return mix.select("cell", F.lit(0.0).alias("total"), F.lit(0.0).alias("ess"))
    if shape.m < 2 or shape.n < 4:
        sizes = dict(sorted(map(tuple, draws.groupBy("chain").count().collect())))
        starts = F.create_map(*[F.lit(v) for c, at in zip(sizes, accumulate([0, *sizes.values()])) for v in (c, at)])
        alone = ess_geyer(draws.withColumn("_pos", starts[F.col("chain")] + F.col("draw")), [], "_pos", x)
        return alone.select("cell", F.col("n").cast("double").alias("total"), "ess")
    even = centred(draws, ["chain"], x)
    moving = mix.where("w > 0")
    own = cut(draws.groupBy("chain").agg(F.count("*").alias("_own")))

    def rho_at(lo: int, hi: int) -> DataFrame:
        mean_acov = lag_products(even, ["chain"], "draw", x, lo, hi).join(own, "chain").join(
            moving.select("cell", "n", "m", "w", "var_hat"), "cell"
        ).groupBy("cell", "n", "lag").agg(
            (F.sum(F.col("s") / F.col("_own")) / F.first("m")).alias("_a"),
            F.first("w").alias("w"), F.first("var_hat").alias("var_hat"))
        rho = 1.0 - (F.col("w") - F.col("_a")) / F.nullif("var_hat", F.lit(0.0))
        return mean_acov.select("cell", "n", "lag", rho.alias("rho"))

    taus = monotone_tau(rho_at, ["cell"], shape.n)
    total = (F.col("m") * F.col("n")).cast("double")
    ess = F.when((F.col("w") == 0) | F.col("tau").isNull(), total).otherwise(total / F.col("tau"))
    return mix.join(taus, "cell", "left").select("cell", total.alias("total"), ess.alias("ess"))


def geweke(draws: DataFrame, x: str, n: int, first: float = 0.1, last: float = 0.5) -> DataFrame:
    """z-score per chain and cell comparing the first and the last part of the chain."""
    n_a, n_b = max(int(n * first), 2), max(int(n * last), 2)
    parts = F.array_compact(F.array(
        F.when(F.col("draw") < n_a, F.struct(F.lit("a").alias("part"), F.col("draw").alias("at"))),
        F.when(F.col("draw") >= n - n_b,
               F.struct(F.lit("b").alias("part"), (F.col("draw") - (n - n_b)).alias("at")))))
    split = draws.withColumn("_p", F.explode(parts)).select("chain", "_p.part", "_p.at", x)
    stats = ess_geyer(split, ["chain", "part"], "at", x)
    error = F.col("var") / F.greatest(F.col("ess"), F.lit(1.0))
    pair = stats.groupBy("chain", "cell").agg(
        F.max(F.when(F.col("part") == "a", F.col("mean"))).alias("_ma"),
        F.max(F.when(F.col("part") == "b", F.col("mean"))).alias("_mb"),
        F.sqrt(F.sum(error)).alias("_se"))
    z = F.when(F.col("_se") == 0, 0.0).otherwise(
        (F.col("_ma") - F.col("_mb")) / F.nullif("_se", F.lit(0.0)))
    return pair.select("chain", "cell", z.alias("z"))


def worst_geweke(draws: DataFrame, x: str, n: int) -> DataFrame:
    """Signed z of largest magnitude over the chains (first chain wins a tie)."""
    z = geweke(draws, x, n)
    return z.groupBy("cell").agg(F.max_by("z", F.struct(F.abs("z"), -F.col("chain"))).alias("geweke"))


def mean_kl(pips: DataFrame, keys: list[str]) -> DataFrame:
    """Mean divergence of the edge probabilities from the prior 1/2."""
    return pips.groupBy(*keys).agg(F.avg(bernoulli_kl(F.col("mean"))).alias("mean_kl"))


def degenerate_cells(draws: DataFrame, x: str) -> DataFrame:
    """Cells whose pooled sample never changes."""
    long = draws.select(F.posexplode(x).alias("cell", "value"))
    return long.groupBy("cell").agg((F.min("value") == F.max("value")).alias("degenerate"))


def efficiency(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Live cells, median ESS, shares with ESS < 100 and R-hat > 1.1, degenerate count.

    ``cells`` has one row per cell (ess, rhat, degenerate); its size is that of one draw.
    """
    live = ~F.col("degenerate")
    return cells.groupBy(*keys).agg(
        F.count_if(live).alias("live"),
        F.median(F.when(live, F.col("ess"))).alias("median_ess"),
        F.avg(F.when(live, (F.col("ess") < 100).cast("double"))).alias("share_low_ess"),
        F.avg(F.when(live, (F.col("rhat") > 1.1).cast("double"))).alias("share_high_rhat"),
        F.count_if("degenerate").alias("degenerate"))
