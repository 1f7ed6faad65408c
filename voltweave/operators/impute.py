"""Gap repair of daily series: forward fill, spline, seasonal fill.

Every operator takes (series keys, date, value) with one row per calendar day and NULL for gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def forward_fill(df: DataFrame, keys: list[str], limit: int = 2) -> DataFrame:
    """Fill at most ``limit`` days after an observation, in every gap."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-limit, Window.currentRow)
    return df.withColumn("value", F.last("value", ignorenulls=True).over(w))


def gap_lengths(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``gap``: length of the NULL run a row lies in, 0 for observed rows."""
    w = Window.partitionBy(*keys).orderBy("date")
    changed = (F.col("value").isNull() != F.lag(F.col("value").isNull()).over(w)).cast("int")
    run = df.withColumn("_run", F.sum(F.coalesce(changed, F.lit(0))).over(w))
    size = F.count("*").over(Window.partitionBy(*keys, "_run"))
    return run.withColumn("gap", F.when(F.col("value").isNull(), size).otherwise(0)).drop("_run")


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with continuous third derivative at the second and last-but-one knot.

    Solves for the second derivatives; the two end conditions are folded into the tridiagonal
    system. Points outside the knots give NaN.
    """
    h = np.diff(x)
    slope = np.diff(y) / h
    n = len(x)
    low, diag, up = h[:-1].copy(), 2.0 * (h[:-1] + h[1:]), h[1:].copy()
    rhs = 6.0 * np.diff(slope)
    # m0 = (1 + h0/h1) m1 - (h0/h1) m2, and the mirror image at the far end.
    r, s = h[0] / h[1], h[-1] / h[-2]
    diag[0] += low[0] * (1 + r)
    up[0] -= low[0] * r
    diag[-1] += up[-1] * (1 + s)
    low[-1] -= up[-1] * s
    m = np.empty(n)
    for k in range(1, n - 2):
        f = low[k] / diag[k - 1]
        diag[k] -= f * up[k - 1]
        rhs[k] -= f * rhs[k - 1]
    m[n - 2] = rhs[-1] / diag[-1]
    for k in range(n - 4, -1, -1):
        m[k + 1] = (rhs[k] - up[k] * m[k + 2]) / diag[k]
    m[0] = (1 + r) * m[1] - r * m[2]
    m[-1] = (1 + s) * m[-2] - s * m[-3]
    seg = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b = x[seg + 1] - at, at - x[seg]
    w = h[seg]
    out = (m[seg] * a**3 + m[seg + 1] * b**3) / (6 * w) \
        + (y[seg] / w - m[seg] * w / 6) * a + (y[seg + 1] / w - m[seg + 1] * w / 6) * b
    out[(at < x[0]) | (at > x[-1])] = np.nan
    return out


def spline_fill(df: DataFrame, keys: list[str], max_gap: int = 7, min_points: int = 4) -> DataFrame:
    """Spline through the observed days for gaps up to ``max_gap``; no extrapolation.

    Each series is packed into arrays (one entry per calendar day), so many series share an Arrow
    batch and the panel is neither joined back nor regrouped.
    """
    packed = gap_lengths(df, keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("date", "value", "gap"))).alias("_days")
    ).select(
        *keys, F.col("_days.date").alias("date"), F.col("_days.value").alias("value"),
        F.transform("_days", lambda d: F.unix_date(d["date"]).cast("double")).alias("_t"),
        F.transform("_days", lambda d: (d["gap"] > 0) & (d["gap"] <= max_gap)).alias("_todo"),
    )
    schema = T.StructType([*packed.schema.fields[:-2], T.StructField("_fill", T.ArrayType(T.DoubleType()))])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fills = []
            for t, v, todo in zip(*[batch.column(c) for c in ("_t", "value", "_todo")]):
                t, todo = np.asarray(t.values), np.asarray(todo.values.to_numpy(zero_copy_only=False), bool)
                y = v.values.to_numpy(zero_copy_only=False)
                seen = ~np.isnan(y)
                out = np.full(len(t), np.nan)
                if todo.any() and seen.sum() >= min_points:
                    out[todo] = not_a_knot(t[seen], y[seen], t[todo])
                fills.append(pa.array(out, from_pandas=True))
            keep = [batch.column(c) for c in schema.names[:-1]]
            lists = pa.array(fills, type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*keep, lists], names=schema.names)

    days = packed.mapInArrow(fill, schema).select(
        *keys, F.explode(F.arrays_zip("date", "value", "_fill")).alias("_d"))
    return days.select(*keys, "_d.date", F.coalesce("_d.value", "_d._fill").alias("value"))


def seasonal_fill(df: DataFrame, keys: list[str], max_gap: int = 16) -> DataFrame:
    """Weekday median plus the time-interpolated residual, for gaps up to ``max_gap``."""
    gaps = gap_lengths(df, keys).withColumn("_dow", F.weekday("date"))
    # Medians over one series' weekdays: bounded by the calendar.
    medians = gaps.groupBy(*keys, "_dow").agg(F.median("value").alias("_season"))
    rest = gaps.join(medians, [*keys, "_dow"]).withColumn("_r", F.col("value") - F.col("_season"))
    w = Window.partitionBy(*keys).orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Looking ahead as a running window over descending days stays linear in the days.
    back = Window.partitionBy(*keys).orderBy(F.desc("date"))
    future = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.when(F.col("_r").isNotNull(), F.struct(F.col("date").alias("d"), F.col("_r").alias("r"),
                                                   F.col("_row").alias("row")))
    spots = rest.withColumn("_row", F.row_number().over(w)).withColumns({
        "_a": F.last(seen, ignorenulls=True).over(past),
        "_b": F.last(seen, ignorenulls=True).over(future),
    })
    span = F.date_diff(F.col("_b.d"), F.col("_a.d"))
    line = F.col("_a.r") + (F.col("_b.r") - F.col("_a.r")) * F.try_divide(
        F.date_diff("date", F.col("_a.d")), span)
    # After the last observation the residual stays level; before the first there is none.
    residual = F.when(F.col("_row") - F.col("_a.row") <= max_gap,
                      F.when(F.col("_b").isNull(), F.col("_a.r")).otherwise(line))
    use = (F.col("gap") > 0) & (F.col("gap") <= max_gap)
    return spots.withColumn(
        "value", F.when(use, residual + F.col("_season")).otherwise(F.col("value"))
    ).select(*df.columns)


def _runs(missing: np.ndarray) -> np.ndarray:
    """For each day the length of the run of missing days it lies in, 0 for the others."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], missing.astype(np.int8), [0]))))
    out = np.zeros(len(missing), np.int64)
    for start, stop in edges.reshape(-1, 2):
        out[start:stop] = stop - start
    return out


def _last_seen(seen: np.ndarray) -> np.ndarray:
    """Index of the last seen day up to each day, -1 before the first."""
    return np.maximum.accumulate(np.where(seen, np.arange(len(seen)), -1)) if len(seen) else np.zeros(0, np.int64)


def repaired(t: np.ndarray, y: np.ndarray, ffill: int, spline: int, seasonal: int, min_points: int = 4) -> np.ndarray:
    """The cascade on one series: ``t`` are day numbers in order, ``y`` its values, NaN in gaps."""
    y, at = y.copy(), np.arange(len(y))
    last = _last_seen(~np.isnan(y))
    near = np.isnan(y) & (last >= 0) & (at - last <= ffill)
    y[near] = y[last[near]]
    missing = np.isnan(y)
    todo = (_runs(missing) <= spline) & missing
    if todo.any() and (~missing).sum() >= min_points:
        y[todo] = not_a_knot(t[~missing], y[~missing], t[todo])
    missing = np.isnan(y)
    todo = (_runs(missing) <= seasonal) & missing
    if todo.any():
        weekday = (t.astype(np.int64) + 3) % 7
        season = np.array([np.median(y[own]) if (own := (weekday == d) & ~missing).any() else np.nan for d in range(7)])[weekday]
        rest = y - season
        before, behind = _last_seen(~missing), len(y) - 1 - _last_seen(~missing[::-1])[::-1]
        level = (before >= 0) & (at - before <= seasonal)
        a, b = before[todo & level], np.minimum(behind[todo & level], len(y) - 1)
        inside = behind[todo & level] < len(y)
        own = t[todo & level]
        line = rest[a] + (rest[b] - rest[a]) * (own - t[a]) / np.where(inside, t[b] - t[a], 1)
        y[todo & level] = np.where(inside, line, rest[a]) + season[todo & level]
    return y


def impute(df: DataFrame, keys: list[str], ffill: int = 2, spline: int = 7, seasonal: int = 16) -> DataFrame:
    """The whole cascade of ``forward_fill``, ``spline_fill`` and ``seasonal_fill``; each stage measures the gaps the
    previous one left. A NaN counts as a gap.

    A series has one row per calendar day, so it is packed into arrays once and passes the three fills together:
    one shuffle and one sort instead of those of nine windows.
    """
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", "value"))).alias("_days")).select(
        *keys, F.col("_days.date").alias("date"), F.col("_days.value").alias("value"),
        F.transform("_days", lambda d: F.unix_date(d["date"]).cast("double")).alias("_t"))
    schema = T.StructType(packed.schema.fields[:-1])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = [
                pa.array(repaired(np.asarray(t.values), v.values.to_numpy(zero_copy_only=False), ffill, spline, seasonal), from_pandas=True)
                for t, v in zip(batch.column("_t"), batch.column("value"))]
            keep = [batch.column(c) for c in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(filled, type=pa.list_(pa.float64()))], names=schema.names)

    return packed.mapInArrow(fill, schema).select(*keys, F.inline(F.arrays_zip("date", "value"))).select(*df.columns)


def gap_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Remaining gaps per series: NULL total, number of gaps, longest gap and the dates."""
    gaps = gap_lengths(df, keys)
    w = Window.partitionBy(*keys).orderBy("date")
    start = F.col("value").isNull() & F.coalesce(F.lag(F.col("value").isNotNull()).over(w), F.lit(True))
    return (
        gaps.withColumn("_start", start).where("value IS NULL").groupBy(*keys)
        .agg(
            F.count("*").alias("total_null"), F.count_if("_start").alias("n_blocks"),
            F.max("gap").alias("max_block_len"), F.sort_array(F.collect_list("date")).alias("dates"),
        )
    )
