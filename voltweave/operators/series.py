"""Ordered analytics over long series whose position is a dense 0-based integer.

A posterior chain can be arbitrarily long, so no operator here gathers a whole series. (Lags up to the
length of a series cost its square here, in blocks; ``spectra`` has all of them at once.) A series is
cut into blocks of consecutive positions; rows near a block edge are copied to the neighbouring
block that needs them, every block is reduced on its own, and the block results are summed.
Rows carry one array per position (all cells of a draw), so one block serves every cell at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltweave.runtime import cut

BLOCK = 4096


def cell_means(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Mean of every cell as one array per series, with the series length ``n``."""
    return (
        df.select(*keys, F.posexplode(x).alias("cell", "_v"))
        .groupBy(*keys, "cell").agg(F.avg("_v").alias("_m"), F.count("*").alias("_n"))
        .groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct("cell", "_m"))).alias("_cells"),
            F.max("_n").alias("n"),
        )
        .select(*keys, "n", F.transform("_cells", lambda c: c["_m"]).alias("_mean"))
    )


#: Means (series x cells) that may pass through the driver.
MAX_MEANS = 4_000_000


def centred(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Subtract the series mean from every cell and add the series length ``n``.

    The means are one array per series, far fewer than draws (``MAX_MEANS`` values at most, else an
    error); as a local table of known size they reach every task, so no series is gathered by its key.
    """
    means = cell_means(df, keys, x)
    if not keys:
        only = means.first()
        joined = df.withColumns({"n": F.lit(only["n"]), "_mean": F.lit(only["_mean"])})
    else:
        size = means.agg(F.coalesce(F.sum(F.size("_mean")), F.lit(0))).first()[0]
        if size > MAX_MEANS:
            raise ValueError(f"{size} means of series and cells; {MAX_MEANS} at most")
        joined = df.join(df.sparkSession.createDataFrame(means.toArrow()), list(keys))
    return joined.withColumn(x, F.zip_with(F.col(x), F.col("_mean"), lambda a, b: a - b)).drop("_mean")


def _products(own_start: int, block: int, lo: int, hi: int, pos: np.ndarray, x: np.ndarray):
    """Sums of x[t]*x[t+k] for the block's own t and every lag k in [lo, hi)."""
    order = np.argsort(pos, kind="stable")
    pos, x = pos[order], x[order]
    own = (pos >= own_start) & (pos < own_start + block)
    ahead = pos >= own_start + lo
    for mask in (own, ahead):
        if np.any(np.diff(pos[mask]) != 1):
            raise ValueError("series positions must be dense and unique")
    mine, theirs = x[own], x[ahead]
    for k in range(lo, hi):
        m = min(len(mine), len(theirs) - (k - lo))
        if m <= 0:
            break
        yield k, np.einsum("tc,tc->c", mine[:m], theirs[k - lo : k - lo + m])


def lag_products(
    df: DataFrame, keys: Sequence[str], pos: str, x: str, lo: int, hi: int, block: int = BLOCK
) -> DataFrame:
    """``(keys, cell, lag, s)`` with s = sum over t of x[t]*x[t+lag], for lags in [lo, hi).

    Lags are taken in ranges no longer than a block and every range of every block is a task of its own, so
    a task never sees more than three blocks of rows, whatever the lags.
    """
    keys = list(keys)
    ranges = max(1, -(-(hi - lo) // block))
    low = F.lit(lo) + F.col("_range") * block
    high = F.least(low + block, F.lit(hi))
    first = F.greatest(F.floor((F.col("_pos") - (high - 1)) / F.lit(block)), F.lit(0))
    last = F.floor((F.col("_pos") - low) / F.lit(block))
    own = F.floor(F.col("_pos") / F.lit(block))
    partner = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    spread = df.select(
        *keys, F.col(pos).cast("long").alias("_pos"), F.col(x).alias("_x"),
        F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("_range"))
    spread = spread.select("*", F.explode(F.array_distinct(F.concat(F.array(own), partner))).alias("_block"))
    fields = [df.schema[k] for k in keys]
    out_schema = T.StructType([
        *fields,
        T.StructField("cell", T.IntegerType()),
        T.StructField("lag", T.IntegerType()),
        T.StructField("s", T.DoubleType()),
    ])

    def reduce_block(key: tuple, table: pa.Table) -> pa.Table:
        values = table.column("_x").combine_chunks()
        cells = len(values[0])
        x_mat = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, cells)
        start = key[-1].as_py() * block
        begin = lo + key[-2].as_py() * block
        end = min(begin + block, hi)
        rows = list(_products(start, block, begin, end, table.column("_pos").to_numpy(), x_mat))
        lags = np.repeat(np.array([k for k, _ in rows], dtype=np.int32), cells)
        sums = np.concatenate([s for _, s in rows]) if rows else np.empty(0)
        columns = [pa.array([k.as_py()] * len(sums), type=k.type) for k in key[:-2]]
        columns.append(pa.array(np.tile(np.arange(cells, dtype=np.int32), len(rows))))
        columns += [pa.array(lags), pa.array(sums, type=pa.float64())]
        return pa.table(columns, names=[*keys, "cell", "lag", "s"])

    parts = spread.groupBy(*keys, "_range", "_block").applyInArrow(reduce_block, out_schema)
    return parts.groupBy(*keys, "cell", "lag").agg(F.sum("s").alias("s"))


def autocovariance_sums(
    df: DataFrame, keys: Sequence[str], pos: str, x: str, max_lag: int, block: int = BLOCK
) -> DataFrame:
    """Centred lag products for lags 0..max_lag with the series length: ``keys, n, cell, lag, s``."""
    keys = list(keys)
    sums = lag_products(centred(df, keys, x), keys, pos, x, 0, max_lag + 1, block)
    if not keys:
        return sums.withColumn("n", F.lit(df.count()))
    return sums.join(df.groupBy(*keys).agg(F.count("*").alias("n")), keys)


def running_means(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, block: int = BLOCK
) -> DataFrame:
    """Mean of all values up to each position, as column ``running_mean``.

    Prefix sums in two levels: windows inside a block, and one over the block totals.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", F.floor(F.col(pos) / block))
    totals = blocked.groupBy(*keys, "_block").agg(
        F.sum(value).alias("_s"), F.count(value).alias("_c")
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_block",
        F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(pos)
    return (
        blocked.join(offsets, [*keys, "_block"])
        .withColumn(
            "running_mean",
            (F.col("_s0") + F.sum(value).over(inside)) / (F.col("_c0") + F.count(value).over(inside)),
        )
        .drop("_block", "_s0", "_c0")
    )


def _monotone_tau(pairs):
    """1 + 2 * (sum of pair sums, stopped at the first non-positive, made non-increasing)."""
    start = F.struct(
        F.lit(0.0).alias("total"), F.lit(float("inf")).alias("last"), F.lit(True).alias("live")
    )

    def step(acc, p):
        live = acc["live"] & (p > 0)
        value = F.least(p, acc["last"])
        return F.struct(
            F.when(live, acc["total"] + value).otherwise(acc["total"]).alias("total"),
            F.when(live, value).otherwise(acc["last"]).alias("last"),
            live.alias("live"),
        )

    return F.aggregate(pairs, start, step, lambda a: F.greatest(1.0 + 2.0 * a["total"], F.lit(1.0)))


def monotone_tau(rho_at, keys: Sequence[str], longest: int, chunk: int = 256) -> DataFrame:
    """Integrated autocorrelation time per series by the initial monotone sequence.

    ``rho_at(lo, hi)`` gives rows ``keys, n, lag, rho`` for lags in [lo, hi). Lags are computed in
    growing ranges until every series has met its first non-positive pair or run out of lags,
    so no autocorrelation is cut off.
    """
    keys = list(keys)
    lo, hi = 0, min(max(chunk, 3), longest)
    known = None
    while True:
        part = cut(rho_at(lo, hi))
        known = part if known is None else known.unionByName(part)
        pairs = (
            known.where(
                (F.col("lag") >= 1) & (F.col("lag") <= 2 * F.floor((F.col("n") - 2) / 2))
            )
            .groupBy(*keys, "n", F.floor((F.col("lag") - 1) / 2).alias("_m"))
            .agg(F.sum("rho").alias("_p"), F.count("*").alias("_c"))
            .where("_c = 2")
        )
        if hi >= longest:
            break
        waiting = (
            pairs.groupBy(*keys, "n")
            .agg(F.min("_p").alias("_low"), F.count("*").alias("_have"))
            .where((F.col("_low") > 0) & (F.col("_have") < F.floor((F.col("n") - 2) / 2)))
        )
        if waiting.isEmpty():
            break
        lo, hi = hi, min(2 * hi, longest)
    taus = pairs.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_m", "_p"))).alias("_pairs")
    )
    return taus.select(
        *keys, _monotone_tau(F.transform("_pairs", lambda p: p["_p"])).alias("tau")
    )
