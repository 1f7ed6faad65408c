"""Exact interpolated quantiles of groups of any size, in one way for all of them.

Values are counted by buckets that keep their order (sign and logarithm), combined before the shuffle; the sums of the buckets of
a group say in which bucket each wanted rank lies, and with its least and largest value that bucket is an interval. Intervals of
many values are counted again by equal parts of their width, until every one is small or of one value.
Then the values inside the wanted intervals alone are put in order. No group, however large, comes together, no value is
dropped, and nothing but the size of the largest interval is read by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltweave.runtime import cut

#: Buckets of a factor e, and parts of an interval that is counted again.
GRAIN, PARTS = 16, 1024
#: Values of an interval that are put in order together.
SMALL = 200_000


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], mean: str | None = None, empty: bool = False
) -> DataFrame:
    """One row per group with a column per named quantile (linear interpolation), and the mean if named.

    NULL values are skipped; infinities count as the smallest and largest, NaN as larger still; NULL is a
    group of its own; a group without values gives no row, or with ``empty`` one of NULLs. Between two unequal infinities the result is
    NaN or infinite, as the arithmetic says. ``df`` is read twice, so what is dear to make should be a table.
    """
    keys = list(keys)
    if not keys:
        whole = df.withColumn("_whole", F.lit(0))
        return exact_quantiles(whole, ["_whole"], value, quantiles, mean, empty).drop("_whole")
    values = df.select(*keys, F.col(value).cast("double").alias("_v"))
    counted = (values if empty else values.where("_v IS NOT NULL")).groupBy(*keys, _bucket("_v").alias("_b")).agg(
        F.count("_v").alias("_c"), F.sum("_v").alias("_s"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # A row for each bucket in use of a group, some ten thousand at most.
    own = Window.partitionBy(*keys)
    counted = counted.withColumns({
        "_n": F.sum("_c").over(own), "_mean": F.sum("_s").over(own) / F.sum("_c").over(own),
        "_before": F.sum("_c").over(own.orderBy("_b")) - F.col("_c")})
    ranks = [(F.col("_n") - 1) * F.lit(float(p)) for p in quantiles.values()]
    wanted = F.array_distinct(F.array(*[f(r).cast("long") for r in ranks for f in (F.floor, F.ceil)]))
    state = [*keys, "_n", "_mean", "_lo", "_hi", "_before", "_c", "_rank"]
    inside = "_n = 0 OR _rank >= _before AND _rank < _before + _c"
    intervals = cut(counted.withColumn("_rank", F.explode(F.when(F.col("_n") > 0, wanted).otherwise(
        F.array(F.lit(None).cast("long"))))).where(inside).select(*state))
    while (intervals.where("_lo < _hi").agg(F.max("_c")).first()[0] or 0) > SMALL:
        intervals = cut(_finer(values, intervals, keys).where(inside).select(*state))

    held = matched(values.where("_v IS NOT NULL"), intervals.select(*keys, "_lo", "_hi").distinct(), keys, ["_lo", "_hi"]).where(
        "_v >= _lo AND _v <= _hi")
    held = held.groupBy(*keys, "_lo", "_hi", "_v").agg(F.count("*").alias("_k"))
    held = held.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v")))
    found = matched(held, intervals, [*keys, "_lo", "_hi"], ["_n", "_mean", "_before", "_rank"]).where(
        "_rank - _before < _upto AND _rank - _before >= _upto - _k")
    at = found.groupBy(*keys, "_n", "_mean").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    columns = [_between(F.col("_at"), r).alias(name) for name, r in zip(quantiles, ranks)]
    out = at.select(*keys, *([F.col("_mean").alias(mean)] if mean else []), *columns)
    if empty:
        nothing = [F.lit(None).cast("double").alias(c) for c in [*([mean] if mean else []), *quantiles]]
        out = out.unionByName(intervals.where("_n = 0").select(*keys, *nothing))
    return out


def _bucket(v: str) -> Column:
    """A whole number that never falls as the value rises; NULL for NULL."""
    x = F.col(v)
    size = F.floor(F.log(F.abs(x)) * GRAIN).cast("int") + 1000 * GRAIN
    most = 2000 * GRAIN
    return (
        F.when(x.isNull(), None).when(F.isnan(x), most + 1).when(x == float("inf"), most).when(x == float("-inf"), -most)
        .when(x > 0, size).when(x < 0, -size).otherwise(0))


def _finer(values: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The intervals with their wanted ranks, those of many values cut into ``PARTS``."""
    large = (F.col("_c") > SMALL) & (F.col("_lo") < F.col("_hi"))
    asked = intervals.where(large)
    ends = asked.select(*keys, "_lo", "_hi").distinct()
    held = matched(values.where("_v IS NOT NULL"), ends, keys, ["_lo", "_hi"]).where("_v >= _lo AND _v <= _hi")
    part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS), F.lit(PARTS - 1))
    counted = held.groupBy(*keys, "_lo", "_hi", part.alias("_b")).agg(
        F.count("*").alias("_k"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    upto = F.sum("_k").over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_b"))
    parts = matched(counted.withColumn("_ahead", upto - F.col("_k")), asked, [*keys, "_lo", "_hi"], ["_n", "_mean", "_before", "_rank"])
    parts = parts.select(
        *keys, "_n", "_mean", F.col("_low").alias("_lo"), F.col("_high").alias("_hi"),
        (F.col("_before") + F.col("_ahead")).alias("_before"), F.col("_k").alias("_c"), "_rank")
    return intervals.where(~F.coalesce(large, F.lit(False))).unionByName(parts)


def _between(at: Column, rank: Column) -> Column:
    low, high = at[F.floor(rank).cast("long")], at[F.ceil(rank).cast("long")]
    return F.when(low == high, low).otherwise(low + (rank - F.floor(rank)) * (high - low))


def matched(
    left: DataFrame, right: DataFrame, keys: Sequence[str], take: Sequence[str] = (), how: str = "inner"
) -> DataFrame:
    """Join on keys in which NULL equals NULL; ``take`` are the columns kept of the right side."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *take)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])
