"""Sub-daily readings to daily country series (long form) and their wide pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltweave.functions.columns import day, ratio


def mapped(mapping: dict[str, str], key: Column) -> Column:
    """Look up a small fixed mapping; an unknown key gives NULL."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def total(x: str) -> Column:
    """Sum in which a group of NULLs counts as 0."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def generation_rows(df: DataFrame, areas: list[str], production_map: dict[str, str]) -> DataFrame:
    """Readings of the wanted production types and areas, labelled with day and energy type."""
    kept = df.where(F.col("production").isin(list(production_map)) & F.col("area").isin(areas))
    return kept.select(
        day("ts").alias("date"), F.col("area").alias("country"),
        mapped(production_map, F.col("production")).alias("variable"), "mw",
    )


def generation_daily(df: DataFrame, areas: list[str], production_map: dict[str, str]) -> DataFrame:
    """Daily sum per country and energy type (sub-daily values are summed, not averaged)."""
    return (
        generation_rows(df, areas, production_map)
        .groupBy("date", "country", "variable").agg(total("mw").alias("value"))
    )


def load_daily(df: DataFrame, areas: list[str]) -> DataFrame:
    """Daily mean load per country."""
    return (
        df.where(F.col("area").isin(areas))
        .groupBy(day("ts").alias("date"), F.col("area").alias("country"))
        .agg(F.avg("mw").alias("value"))
    )


def price_rows(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Prices of known zones with their country; ``zones`` is the small dimension (zone, country)."""
    return df.join(zones, "zone").select(day("ts").alias("date"), "country", "zone", "price")


def exact_mean(column: str) -> Column:
    """Mean of values of up to eight decimals, the same whatever the order of the rows."""
    return F.sum(F.col(column).cast("decimal(28,8)")).cast("double") / F.count(column)


def price_daily(rows: DataFrame) -> DataFrame:
    """Mean of the zones' daily means, so that a zone with more readings weighs no more."""
    zone_means = rows.groupBy("date", "country", "zone").agg(exact_mean("price").alias("_zone"))
    return zone_means.groupBy("date", "country").agg(exact_mean("_zone").alias("value"))


def forecast_daily(df: DataFrame, areas: list[str]) -> DataFrame:
    """Daily sum of forecast readings per country."""
    return (
        df.where(F.col("area").isin(areas))
        .groupBy(day("ts").alias("date"), F.col("area").alias("country"))
        .agg(total("mw").alias("value"))
    )


def reserve_margin(generation: DataFrame, load: DataFrame) -> DataFrame:
    """(generation - load) / load per day and country; both sides are already one row per key."""
    g = generation.select("date", "country", F.col("value").alias("generation"))
    d = load.select("date", "country", F.col("value").alias("load"))
    return g.join(d, ["date", "country"]).withColumn(
        "value", ratio(F.col("generation") - F.col("load"), F.col("load"))
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The frame itself, or an error when it holds no row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def labelled(df: DataFrame, variable: str | None = None) -> DataFrame:
    """Add the column key ``COUNTRY_variable``."""
    suffix = F.lit(variable) if variable else F.col("variable")
    return df.withColumn("column", F.concat_ws("_", "country", suffix))


def pivot_daily(
    long: DataFrame, how: str, fill: float | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Wide panel, one row per day and one column per label in alphabetical order.

    The labels are a dimension (countries x variables); pass them to save the job that lists them.
    """
    if columns is None:
        columns = [r[0] for r in long.select("column").distinct().collect()]
    columns = sorted(columns)
    agg = {"sum": F.sum, "mean": F.avg}[how]
    wide = long.groupBy("date").pivot("column", columns).agg(agg("value"))
    return wide.fillna(fill, columns) if fill is not None else wide
