"""Sufficient statistics, priors and scores of the graphical VAR, as joins and aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS_PER_BLOCK = 256


@dataclass(frozen=True)
class Dims:
    """Endogenous and exogenous variables and the lags.

    A design row is [y | per lag: endogenous, exogenous]; regressor k of lag position s is column
    ny + s * (ny + nz) + k.
    """

    ny: int
    nz: int
    lags: tuple[int, ...]

    @property
    def n_par(self) -> int:
        return (self.ny + self.nz) * len(self.lags)

    @property
    def width(self) -> int:
        return self.ny + self.n_par

    def regressor_is_endo(self) -> np.ndarray:
        return (np.arange(self.n_par) % (self.ny + self.nz)) < self.ny


def day_vectors(panel: DataFrame) -> DataFrame:
    """Long panel (date, idx, value) to one row per day with the values in index order."""
    return panel.groupBy("date").agg(
        F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("_v")
    ).select("date", F.transform("_v", lambda p: p["value"]).alias("v"))


def design_rows(endo: DataFrame, exog: DataFrame, dims: Dims) -> DataFrame:
    """One design row per day t after the longest lag: (t, d).

    Every day is sent to the days that use it as a lag, so no global window is needed. Lags are row
    offsets in the calendar, whose index comes from the sorted days (bounded by the calendar).
    """
    days = endo.select("date").distinct().agg(F.sort_array(F.collect_set("date")).alias("_d")).select(
        F.posexplode("_d").alias("_t", "date"))
    rows = endo.withColumnRenamed("v", "_y").join(exog.withColumnRenamed("v", "_x"), "date").join(days, "date")
    offsets = F.array(*[F.lit(k) for k in (0, *dims.lags)])
    spread = rows.select("_t", "_y", "_x", F.explode(offsets).alias("_lag")).select(
        (F.col("_t") + F.col("_lag") - max(dims.lags)).alias("t"), "_lag",
        F.when(F.col("_lag") == 0, F.col("_y")).otherwise(F.concat("_y", "_x")).alias("_part"))
    full = spread.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("_lag", "_part"))).alias("_p"))
    return full.where((F.size("_p") == len(dims.lags) + 1) & (F.col("t") >= 0)).select(
        "t", F.flatten(F.transform("_p", lambda p: p["_part"])).alias("d"))


def gram(rows: DataFrame, keys: list[str], d: str = "d", weight: str | None = None) -> DataFrame:
    """Packed cross products sum w d d' per key, added up inside each partition before the shuffle."""
    names = [*keys, "gram"]
    schema = rows.select(*keys, F.col(d).alias("gram")).schema

    def partial(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column("_d").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            w = batch.column("_w").to_numpy(zero_copy_only=False)
            # One number per key, from the codes of its columns; a batch has few different keys.
            code = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                own = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                code = code * (own.max() + 1) + own
            kinds, at, which = np.unique(code, return_index=True, return_inverse=True)
            for kind in range(len(kinds)):
                owner = tuple(batch.column(k)[int(at[kind])].as_py() for k in keys)
                mine = slice(None) if len(kinds) == 1 else which == kind
                sums[owner] = sums.get(owner, 0) + (x[mine] * w[mine, None]).T @ x[mine]
        for owner, g in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], type=pa_type(schema, k)) for v, k in zip(owner, keys)]
                + [pa.array([g.ravel().tolist()], type=pa.list_(pa.float64()))], names=names)

    w = F.col(weight) if weight else F.lit(1.0)
    parts = rows.select(*keys, F.col(d).alias("_d"), w.alias("_w")).mapInArrow(partial, schema)
    cells = parts.select(*keys, F.posexplode("gram").alias("cell", "s")).groupBy(*keys, "cell").agg(
        F.sum("s").alias("s"))
    return cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cell", "s"))).alias("_g")).select(
        *keys, F.transform("_g", lambda p: p["s"]).alias("gram"))


def pa_type(schema, name: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[schema[name].dataType.simpleString()]


def gram_cells(packed: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """Packed Gram matrix as (a, b, s) rows."""
    return packed.select(*keys, F.posexplode("gram").alias("_c", "s")).select(
        *keys, F.floor(F.col("_c") / width).cast("int").alias("a"), (F.col("_c") % width).cast("int").alias("b"), "s")


def minnesota_variances(dims: Dims, pi_shrink: float, decay: float, exog_weight: float) -> np.ndarray:
    """Prior variance per regressor: shrinkage / lag^decay; the exogenous part counts lags by
    ordinal, not by value."""
    out = np.empty(dims.n_par)
    step = dims.ny + dims.nz
    for s, lag in enumerate(dims.lags):
        out[s * step : s * step + dims.ny] = pi_shrink / lag**decay
        out[s * step + dims.ny : (s + 1) * step] = pi_shrink * exog_weight / (s + 1) ** decay
    return out


def minnesota_table(regressors: DataFrame, pi_shrink: float, decay: float, exog_weight: float) -> DataFrame:
    """The same per regressor row with columns block ('endo'/'exog'), lag and lag_ordinal."""
    endo = F.lit(pi_shrink) / F.pow("lag", F.lit(decay))
    exog = F.lit(pi_shrink * exog_weight) / F.pow("lag_ordinal", F.lit(decay))
    return regressors.withColumn("omega", F.when(F.col("block") == "endo", endo).otherwise(exog))


@dataclass(frozen=True)
class BlockScore:
    """Gaussian marginal likelihood constants for blocks of n variables out of T observations."""

    alpha: float
    c0: float
    t_obs: int

    @staticmethod
    def contemporaneous(ny: int, t_obs: int) -> "BlockScore":
        return BlockScore.of(float(max(ny + 2, t_obs // 4)), ny, t_obs)

    @staticmethod
    def temporal(dims: Dims, t_obs: int) -> "BlockScore":
        return BlockScore.of(float(max(dims.n_par + 3, t_obs // 4)), dims.width, t_obs)

    @staticmethod
    def of(alpha: float, width: int, t_obs: int) -> "BlockScore":
        c0 = alpha - width - 1
        return BlockScore(alpha, c0 if c0 > 0 else 1.0, t_obs)

    def offset(self, n: int) -> float:
        """Part of the log marginal of an n-variable block that depends on its size only."""
        post = (self.alpha + self.t_obs) / 2
        gammas = sum(lgamma(post - k / 2) - lgamma(self.alpha / 2 - k / 2) for k in range(n))
        return -n * self.t_obs / 2 * log(pi) + gammas + self.alpha / 2 * n * log(self.c0)

    def log_marginal(self, post: np.ndarray, block) -> float:
        block = list(block)
        if not block:
            return 0.0
        logdet = np.linalg.slogdet(post[np.ix_(block, block)])[1]
        return self.offset(len(block)) - (self.alpha + self.t_obs) / 2 * logdet

    def local(self, post: np.ndarray, response: int, parents) -> float:
        """Log score of a response given its parents."""
        return self.log_marginal(post, [response, *parents]) - self.log_marginal(post, parents)


def single_edge_scores(cells: DataFrame, score: BlockScore, responses: int, candidates: Column) -> DataFrame:
    """Gain of adding one parent b to response a with none: score(a | b) - score(a | nothing).

    ``cells`` are Gram rows (a, b, s); only 1 x 1 and 2 x 2 determinants occur, so it is a join of
    each cell with the two diagonal cells.
    """
    diag = cells.where("a = b").select(F.col("a").alias("_k"), (F.col("s") + score.c0).alias("_s"))
    pairs = cells.where((F.col("a") < responses) & (F.col("a") != F.col("b")) & candidates)
    both = pairs.join(diag.select(F.col("_k").alias("a"), F.col("_s").alias("_aa")), "a").join(
        diag.select(F.col("_k").alias("b"), F.col("_s").alias("_bb")), "b")
    half = (score.alpha + score.t_obs) / 2
    det = F.col("_aa") * F.col("_bb") - F.col("s") * F.col("s")
    gain = (score.offset(2) - 2 * score.offset(1)) - half * (F.ln(det) - F.ln("_aa") - F.ln("_bb"))
    return both.select("a", "b", gain.alias("gain"))


def residual_rows(design: DataFrame, coefs: DataFrame, dims: Dims) -> DataFrame:
    """u_t = y_t - A x_t in long form (t, i, u); ``coefs`` is (i, col, coef) with col a design column."""
    long = design.select("t", F.posexplode("d").alias("col", "x"))
    fitted = long.join(coefs, "col").groupBy("t", "i").agg(F.sum(F.col("x") * F.col("coef")).alias("_f"))
    y = long.where(F.col("col") < dims.ny).select("t", F.col("col").alias("i"), F.col("x").alias("y"))
    return y.join(fitted, ["t", "i"], "left").select(
        "t", "i", (F.col("y") - F.coalesce("_f", F.lit(0.0))).alias("u"))


def scaled_residuals(residuals: DataFrame, h: DataFrame) -> DataFrame:
    """Residuals divided by exp(h_t / 2)."""
    return residuals.join(h, "t").withColumn("u_scaled", F.col("u") / F.exp(F.col("h") / 2))


def quadratic_forms(residuals: DataFrame, precision: DataFrame) -> DataFrame:
    """q_t = u_t' P u_t (at least 1e-12) with P as (i, j, p) rows."""
    right = residuals.select("t", F.col("i").alias("j"), F.col("u").alias("_uj"))
    half = right.join(precision, "j").groupBy("t", "i").agg(F.sum(F.col("p") * F.col("_uj")).alias("_pu"))
    return half.join(residuals, ["t", "i"]).groupBy("t").agg(
        F.greatest(F.sum(F.col("u") * F.col("_pu")), F.lit(1e-12)).alias("q"))


def volatility_log_target(path: DataFrame, keys: list[str], ny: int, sigma_h2: float, v_h0: float) -> DataFrame:
    """Log full conditional of every h_t given its neighbours, up to a constant.

    ``path`` is (keys, t, h, q); a series is one calendar of days.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    before, after = F.lag("h").over(w), F.lead("h").over(w)
    likelihood = -0.5 * ny * F.col("h") - 0.5 * F.col("q") * F.exp(-F.col("h"))
    past = F.when(before.isNull(), -0.5 * F.col("h") ** 2 / v_h0).otherwise(
        -0.5 * (F.col("h") - before) ** 2 / sigma_h2)
    future = F.coalesce(-0.5 * (after - F.col("h")) ** 2 / sigma_h2, F.lit(0.0))
    return path.withColumn("log_target", likelihood + past + future)


def innovation_posterior(path: DataFrame, keys: list[str], shape: float, scale: float) -> DataFrame:
    """Inverse-gamma posterior of the innovation variance of each path."""
    w = Window.partitionBy(*keys).orderBy("t")
    eta = path.withColumn("_eta", F.col("h") - F.lag("h").over(w))
    return eta.groupBy(*keys).agg(
        (shape + F.count("_eta") / 2).alias("shape"), (scale + 0.5 * F.sum(F.col("_eta") ** 2)).alias("scale"))
