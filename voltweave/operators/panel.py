"""Balanced daily panel: country selection, calendar, order, scaling and lags.

The panel is kept long (date, country, variable, value). A series holds one row per calendar day,
so windows partitioned by series are bounded by the calendar, whatever the size of the raw feed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wanted_columns(available: list[str], countries: list[str], variable: str) -> tuple[list[str], list[str]]:
    """Existing and missing ``COUNTRY_variable`` columns of a wide panel, in country order."""
    names = [f"{c}_{variable}" for c in countries]
    return [n for n in names if n in available], [n for n in names if n not in available]


def included_countries(countries: DataFrame, price: DataFrame, load: DataFrame) -> DataFrame:
    """Countries with both a price and a load series, in the given order."""
    for side in (price, load):
        countries = countries.join(side.select("country").distinct(), "country", "left_semi")
    return countries


def excluded_countries(countries: DataFrame, price: DataFrame, load: DataFrame) -> DataFrame:
    """Countries lacking a series, with what they lack."""
    for name, side in (("Price", price), ("Load", load)):
        has = side.select("country").distinct().withColumn(name, F.lit(True))
        countries = countries.join(has, "country", "left")
    reasons = F.concat_ws(", ", *[
        F.when(F.col(name).isNull(), F.lit(name)) for name in ("Price", "Load")])
    lacking = F.col("Price").isNull() | F.col("Load").isNull()
    return countries.where(lacking).select("country", reasons.alias("missing"))


def common_calendar(panels: list[DataFrame]) -> DataFrame:
    """Days present in every panel."""
    days = [p.select("date").distinct() for p in panels]
    return reduce(lambda a, b: a.join(b, "date", "left_semi"), days)


#: Days that a calendar may have.
MAX_DAYS = 20_000


def on_calendar(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Reindex each series to the calendar: absent days become NULL, other days are dropped.

    Every series unfolds the days of the calendar, which are read once (``MAX_DAYS`` at most, else an
    error), so the grid is built per series, no pairwise join is needed, and a stray date adds one day.
    """
    keys = [c for c in panel.columns if c not in ("date", "value")]
    days = sorted(r[0] for r in calendar.select("date").distinct().limit(MAX_DAYS + 1).collect() if r[0] is not None)
    if len(days) > MAX_DAYS:
        raise ValueError(f"a calendar of more than {MAX_DAYS} days")
    # One literal, not one for each day.
    listed = F.split(F.lit(",".join(map(str, days))), ",").cast("array<date>") if days else F.array().cast("array<date>")
    grid = panel.select(*keys).distinct().withColumn("date", F.explode(listed))
    return grid.join(panel, [*keys, "date"], "left")


def interleaved(panel: DataFrame, countries: DataFrame, variables: list[str]) -> DataFrame:
    """Column position ``country_idx * len(variables) + variable position``."""
    spot = F.array_position(F.array(*[F.lit(v) for v in variables]), F.col("variable")) - 1
    return panel.where(F.col("variable").isin(variables)).join(countries, "country").withColumn(
        "position", (F.col("idx") * len(variables) + spot).cast("int"))


def drop_columns(panel: DataFrame, names: list[str]) -> DataFrame:
    return panel.where(~F.concat_ws("_", "country", "variable").isin(names))


def endogenous(panel: DataFrame, mode: str = "all") -> DataFrame:
    """All columns, or those whose name contains 'price'."""
    if mode == "all":
        return panel
    if mode != "prices_only":
        raise ValueError(f"unknown mode {mode!r}")
    return panel.where(F.lower("column").contains("price"))


def exogenous_columns(columns: list[str], suffixes: list[str]) -> list[str]:
    """Columns by suffix block (a column may match by substring, case-insensitive)."""
    picked: list[str] = []
    for suffix in suffixes:
        hits = [c for c in columns if suffix.lower() in c.lower()]
        if not hits:
            raise ValueError(f"no column matches {suffix!r}")
        picked += hits
    return picked


def exogenous(panel: DataFrame, suffixes: list[str]) -> DataFrame:
    """Long form of the same: one block per suffix, ordered by (suffix position, column)."""
    lower = F.lower("column")
    hits = F.filter(
        F.array(*[F.when(lower.contains(s.lower()), F.lit(k)) for k, s in enumerate(suffixes)]),
        lambda k: k.isNotNull(),
    )
    return panel.withColumn("block", F.explode(hits))


def moments(panel: DataFrame, keys: list[str]) -> DataFrame:
    return panel.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


def standardise(panel: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """z-scores per series. A constant series is an error (strict) or becomes zeros."""
    stats = moments(panel, keys)
    flat = F.col("std") < 1e-10
    if strict:
        bad = stats.where(flat).select(*keys).collect()
        if bad:
            raise ValueError(f"zero-variance columns: {[tuple(r) for r in bad]}")
    scale = F.when(flat, F.lit(1.0)).otherwise(F.col("std"))
    return panel.join(stats.select(*keys, "mean", scale.alias("std")), keys).withColumn(
        "z", (F.col("value") - F.col("mean")) / F.col("std"))


def lag_design(panel: DataFrame, keys: list[str], lags: list[int], value: str = "value") -> DataFrame:
    """Value with its row-offset lags; the first max(lags) rows of each series are dropped."""
    w = Window.partitionBy(*keys).orderBy("date")
    cols: dict[str, Column] = {f"lag{k}": F.lag(value, k).over(w) for k in lags}
    return (
        panel.withColumns(cols).withColumn("_t", F.row_number().over(w))
        .where(F.col("_t") > max(lags)).drop("_t")
    )


def first_difference(panel: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Day-to-day change per series; the first day has none."""
    w = Window.partitionBy(*keys).orderBy("date")
    return panel.withColumn("eta", F.col(value) - F.lag(value).over(w)).where("eta IS NOT NULL")


def ar1_residual_variance(panel: DataFrame, keys: list[str], max_lag: int, value: str = "value") -> DataFrame:
    """Residual variance of an AR(1) fit per series (population moments, rows after max_lag)."""
    w = Window.partitionBy(*keys).orderBy("date")
    pairs = (
        panel.withColumn("_x", F.lag(value, 1).over(w)).withColumn("_t", F.row_number().over(w))
        .where(F.col("_t") > max_lag)
    )
    fit = pairs.groupBy(*keys).agg(
        F.covar_pop(value, "_x").alias("_c"), F.var_pop("_x").alias("_vx"),
        F.var_pop(value).alias("_vy"),
    )
    # Residual variance of the least-squares line: var(y) - cov^2 / var(x).
    return fit.select(*keys, (F.col("_vy") - F.col("_c") ** 2 / F.nullif("_vx", F.lit(0.0))).alias("sigma2"))
