"""Command line of the jobs, for spark-submit: ``jobs.py generation FILES -o OUT`` and so on."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.functions.fixed import AREA_CODES, NETWORK_CODES, PRODUCTION_MAP, ZONE_TO_COUNTRY
from voltweave.operators import ingest, network
from voltweave.sources import market, tables


def generation(spark: SparkSession, files: list[str]) -> DataFrame:
    rows = market.read_feed(spark, "generation", market.expand_paths(spark, files))
    daily = ingest.require_rows(ingest.generation_daily(rows, AREA_CODES, PRODUCTION_MAP), "no generation data")
    return ingest.pivot_daily(ingest.labelled(daily), "sum", fill=0.0)


def load(spark: SparkSession, files: list[str]) -> DataFrame:
    rows = market.read_feed(spark, "load", market.expand_paths(spark, files))
    daily = ingest.require_rows(ingest.load_daily(rows, AREA_CODES), "no load data")
    return ingest.pivot_daily(ingest.labelled(daily, "Load"), "mean", fill=0.0)


def price(spark: SparkSession, files: list[str]) -> DataFrame:
    rows = market.read_feed(spark, "price", market.expand_paths(spark, files))
    zones = spark.createDataFrame(sorted(ZONE_TO_COUNTRY.items()), "zone string, country string")
    daily = ingest.require_rows(ingest.price_daily(ingest.price_rows(rows, zones)), "no price data")
    return ingest.pivot_daily(ingest.labelled(daily, "Price"), "mean")


def reserve(spark: SparkSession, gen: list[str], demand: list[str]) -> DataFrame:
    sides = [
        ingest.forecast_daily(market.read_feed(spark, kind, market.expand_paths(spark, files)), AREA_CODES)
        for kind, files in (("generation_forecast", gen), ("load_forecast", demand))
    ]
    margin = ingest.require_rows(ingest.reserve_margin(*sides), "the feeds share no day and country")
    return ingest.pivot_daily(ingest.labelled(margin, "RM"), "mean")


def transfer_network(spark: SparkSession, folder: str, threshold: float, how: str) -> tuple[DataFrame, DataFrame]:
    """Binarised capacity matrix and node list."""
    rows = market.read_capacity_dir(spark, folder)
    clean = network.within(network.clean_capacity(rows, ["source_file", "source_block", "source_row"]), NETWORK_CODES)
    edges = network.capacity_edges(clean, how)
    nodes = network.node_list(edges)
    return network.binarise(network.dense_matrix(edges, nodes), threshold), nodes


def filtered_network(spark: SparkSession, matrix_path: str, countries_path: str) -> DataFrame:
    """Adjacency limited to the final countries, in their order."""
    matrix = tables.read_matrix_csv(spark, matrix_path)
    countries = tables.read_countries(spark, countries_path)
    network.check_countries(matrix, countries)
    return network.submatrix(matrix, countries)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voltweave")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("generation", "load", "price"):
        one = commands.add_parser(name)
        one.add_argument("files", nargs="+")
        one.add_argument("-o", "--output", required=True)
    both = commands.add_parser("reserve")
    both.add_argument("--gen", nargs="+", required=True)
    both.add_argument("--load", nargs="+", required=True)
    both.add_argument("-o", "--output", required=True)
    net = commands.add_parser("network")
    net.add_argument("--data_dir", required=True)
    net.add_argument("--threshold", type=float, default=500.0)
    net.add_argument("--agg", choices=["mean", "max", "median"], default="mean")
    net.add_argument("--output_dir", required=True)
    sub = commands.add_parser("filter-network")
    sub.add_argument("--matrix", required=True)
    sub.add_argument("--countries", required=True)
    sub.add_argument("-o", "--output", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("voltweave").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if args.command == "network":
        if args.output_dir.rstrip("/") == args.data_dir.rstrip("/"):
            raise ValueError("the output folder must differ from the data folder")
        matrix, nodes = transfer_network(spark, args.data_dir, args.threshold, args.agg)
        tables.write_matrix_csv(matrix, "g0", f"{args.output_dir}/G0_matrix")
        tables.write_matrix_csv(matrix, "capacity_mw", f"{args.output_dir}/G0_capacity_matrix")
        tables.write_countries(nodes.select("idx", F.col("node").alias("country")), f"{args.output_dir}/zone_list")
        return
    if args.command == "filter-network":
        # A new place: the unfiltered matrix stays as its own backup.
        tables.write_matrix_csv(filtered_network(spark, args.matrix, args.countries), "value", args.output, ("i", "j"))
        return
    wide = reserve(spark, args.gen, args.load) if args.command == "reserve" else {
        "generation": generation, "load": load, "price": price}[args.command](spark, args.files)
    tables.write_panel_csv(wide, args.output)


if __name__ == "__main__":
    main()
