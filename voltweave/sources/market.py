"""Market text files: header-driven scans into canonical columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltweave.functions.columns import clean


@dataclass(frozen=True)
class Feed:
    """Columns of one kind of file: header name -> (canonical name, type)."""

    columns: dict[str, tuple[str, str]]
    sniff: bool = False


# Header names of the market files.
FEEDS = {
    "generation": Feed({
        "DateTime(UTC)": ("ts", "timestamp"),
        "AreaMapCode": ("area", "string"),
        "ProductionType": ("production", "string"),
        "ActualGenerationOutput[MW]": ("mw", "double"),
    }),
    "load": Feed({
        "DateTime(UTC)": ("ts", "timestamp"),
        "AreaMapCode": ("area", "string"),
        "TotalLoad[MW]": ("mw", "double"),
    }, sniff=True),
    "price": Feed({
        "DateTime(UTC)": ("ts", "timestamp"),
        "MapCode": ("zone", "string"),
        "Price[Currency/MWh]": ("price", "double"),
    }, sniff=True),
    "generation_forecast": Feed({
        "DateTime(UTC)": ("ts", "timestamp"),
        "AreaMapCode": ("area", "string"),
        "GenerationForecast[MW]": ("mw", "double"),
    }),
    "load_forecast": Feed({
        "DateTime(UTC)": ("ts", "timestamp"),
        "AreaMapCode": ("area", "string"),
        "TotalLoad[MW]": ("mw", "double"),
    }),
    "transfer_capacity": Feed({
        "DateTime(UTC)": ("datetime", "timestamp"),
        "OutAreaCode": ("from_code", "string"),
        "OutAreaDisplayName": ("from_name", "string"),
        "OutMapCode": ("from_map", "string"),
        "InAreaCode": ("to_code", "string"),
        "InAreaDisplayName": ("to_name", "string"),
        "InMapCode": ("to_map", "string"),
        "ForecastTransferCapacity[MW]": ("capacity_mw", "double"),
        "ContractType": ("contract_type", "string"),
        "ResolutionCode": ("resolution", "string"),
    }),
}


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files matching a pattern, sorted (only the listing is read, no content)."""
    try:
        found = spark.read.format("binaryFile").load(pattern).select("path")
        return sorted(r.path for r in found.collect())
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def expand_paths(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Every pattern's matches in order; a pattern without match is kept as it is."""
    return [p for pattern in patterns for p in (list_paths(spark, pattern) or [pattern])]


def read_feed(spark: SparkSession, kind: str, paths: list[str]) -> DataFrame:
    """Scan files of one kind. Columns are found by header name; other columns are never parsed."""
    return _scan(spark, kind, paths).drop("source_file", "source_block", "source_row")


def canonical(table: DataFrame, kind: str) -> DataFrame:
    """A feed that came as a table, under its header names: canonical columns and types, in the feed's order. Other
    columns go; an error names headers that are missing."""
    feed = FEEDS[kind]
    missing = [h for h in feed.columns if h not in table.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return table.select(*[F.col(f"`{h}`").cast(type_).alias(name) for h, (name, type_) in feed.columns.items()])


def read_capacity_dir(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.csv`` transfer-capacity files of a folder, with the source order kept as columns."""
    paths = list_paths(spark, f"{folder}/*.csv")
    if not paths:
        raise FileNotFoundError(f"no CSV file in {folder}")
    return _scan(spark, "transfer_capacity", paths)


def _scan(spark: SparkSession, kind: str, paths: list[str]) -> DataFrame:
    """One scan for all files of the same header line, however many there are.

    Source order: file (by name), place of the split in it, row within the task.
    """
    by_header: dict[str, list[str]] = {}
    for path, first in headers(spark, paths).items():
        by_header.setdefault(first, []).append(path)
    return reduce(DataFrame.unionByName, [_read_files(spark, kind, h, p) for h, p in by_header.items()])


def headers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first line of every file, by path in the given order; one job, in which each file is a task of its own that
    stops behind the first lines it is handed. An empty file is an error."""
    if not paths:
        return {}
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                if batch.column("start")[0].as_py() == 0:
                    yield batch.slice(0, 1).select(["path", "value"])
                return

    # A split that costs as much to open as a partition holds isn't put together with others.
    cost, most = "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    before = spark.conf.get(cost)
    spark.conf.set(cost, most)
    try:
        rows = lines.mapInArrow(first, "path string, value string").collect()  # a row for each file
    finally:
        spark.conf.set(cost, before)
    found = {unquote(urlparse(r.path).path): r.value for r in rows}
    places = {p: _place(spark, p) for p in paths}
    empty = [p for p, place in places.items() if place not in found]
    if empty:
        raise ValueError(f"empty file: {empty[0]}")
    return {p: found[place].lstrip("\ufeff") for p, place in places.items()}


def _place(spark: SparkSession, path: str) -> str:
    """The absolute path without its scheme."""
    if not re.match("[a-z0-9]+:|/", path):
        named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(named).toString()
    return re.sub("/+", "/", re.sub("^[a-z0-9]+:(//[^/]*)?", "", path))


def _read_files(spark: SparkSession, kind: str, header: str, paths: list[str]) -> DataFrame:
    feed = FEEDS[kind]
    sep = "\t" if not feed.sniff or "\t" in header else ","
    names = [n.strip('"') for n in header.split(sep)]
    missing = [n for n in feed.columns if n not in names]
    if missing:
        raise ValueError(f"{paths[0]}: missing columns {missing}")
    types = [
        T.StructField(feed.columns[n][0] if n in feed.columns else f"_skip{k}",
                      T.TimestampType() if feed.columns.get(n, ("", ""))[1] == "timestamp"
                      else T.DoubleType() if feed.columns.get(n, ("", ""))[1] == "double"
                      else T.StringType())
        for k, n in enumerate(names)
    ]
    scan = spark.read.schema(T.StructType(types)).option("sep", sep).option("header", True).csv(paths)
    return scan.select(
        *[clean(alias).alias(alias) if kind_ == "double" else F.col(alias) for alias, kind_ in feed.columns.values()],
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"))
