"""Scans and sinks of panels, labelled matrices, country lists and posterior draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.operators.draws import check_chains
from voltweave.operators.ingest import pivot_daily


def write_panel_csv(wide: DataFrame, path: str) -> None:
    """Wide daily panel as CSV, in date order (range-partitioned, not one file)."""
    wide.orderBy("date").write.mode("overwrite").option("header", True).csv(path)


def read_panel_csv(spark: SparkSession, path: str, date_col: int = 0) -> DataFrame:
    """Panel with a date column and one double column per series, sorted by date."""
    names = spark.read.option("header", True).csv(path).columns
    fields = ", ".join(f"`{n}` {'DATE' if k == date_col else 'DOUBLE'}" for k, n in enumerate(names))
    scan = spark.read.schema(fields).option("header", True).csv(path)
    return scan.withColumnRenamed(names[date_col], "date").orderBy("date")


def write_matrix_csv(cells: DataFrame, value: str, path: str, order: tuple[str, str] | None = None) -> None:
    """Square matrix with row labels, one column per node (nodes are a small dimension).

    Rows and columns go by label, or by the columns of ``order`` (of the row, of the column).
    """
    row, column = order or ("src", "dst")
    names = [r[1] for r in sorted(cells.select(column, "dst").distinct().collect())]
    wide = cells.groupBy(F.col(row).alias("_order"), "src").pivot("dst", names).agg(F.first(value))
    wide.orderBy("_order").drop("_order").write.mode("overwrite").option("header", True).csv(path)


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled matrix as edges: src = row label, dst = column label, value."""
    names = spark.read.option("header", True).csv(path).columns
    fields = ", ".join(f"`{n}` {'STRING' if k == 0 else 'DOUBLE'}" for k, n in enumerate(names))
    wide = spark.read.schema(fields).option("header", True).csv(path)
    return wide.unpivot([names[0]], names[1:], "dst", "value").withColumnRenamed(names[0], "src")


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """Ordered country list: idx, country."""
    names = [r.country for r in spark.read.schema("country STRING").option("header", True).csv(path).collect()]
    return spark.createDataFrame(list(enumerate(names)), "idx int, country string")


def write_countries(countries: DataFrame, path: str) -> None:
    countries.orderBy("idx").select("country").coalesce(1).write.mode("overwrite").option(
        "header", True).csv(path)


def write_panel(panel: DataFrame, path: str) -> None:
    """Long standardised panel, partitioned by block (Y or X)."""
    panel.write.mode("overwrite").partitionBy("block").parquet(path)


def read_panel(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Y and X blocks; an error when they cover different numbers of days."""
    both = spark.read.parquet(path)
    y, x = both.where("block = 'Y'"), both.where("block = 'X'")
    days = {r.block: r.n for r in both.groupBy("block").agg(F.countDistinct("date").alias("n")).collect()}
    if days.get("X") is not None and days.get("X") != days.get("Y"):
        raise ValueError(f"row counts differ: {days}")
    return y.drop("block"), x.drop("block")


def write_wide(long: DataFrame, path: str) -> None:
    wide = pivot_daily(long, "mean")
    wide.write.mode("overwrite").parquet(path)


def write_draws(draws: DataFrame, path: str) -> None:
    """Draws by chain; a chain that is written again replaces the stored one."""
    draws.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chain").parquet(path)


def read_draws(spark: SparkSession, path: str, n_chains: int, skip: tuple[str, ...] = ("mu_h", "phi_h"), uneven: bool = False) -> DataFrame:
    """Packed draws of all chains; excluded quantities are never read.

    An error when a chain is absent, the chains differ in length (unless ``uneven``) or a draw is there twice.
    """
    found = spark.read.parquet(path)
    check_chains(found, n_chains, uneven)
    twice = found.groupBy("chain", "draw").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"draws stored twice: {twice.limit(5).collect()}")
    return found.drop(*skip)
