"""Directed transfer-capacity network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltweave.operators.quantiles import exact_quantiles
from voltweave.runtime import cut

DEDUPE_KEYS = ["datetime", "from_code", "to_code", "contract_type"]


def merged_code(code: str, prefix: str, merged: str) -> Column:
    """Codes starting with the prefix become one code."""
    return F.when(F.col(code).startswith(prefix), F.lit(merged)).otherwise(F.col(code))


def normalise_codes(df: DataFrame, prefix: str = "DE_", merged: str = "DE") -> DataFrame:
    return df.withColumns({c: merged_code(c, prefix, merged) for c in ("from_map", "to_map")})


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of every key in source order.

    Rows that agree in the order go by their other columns, NULL first. Only the first row of a key leaves a task that reads ``df``
    (Spark puts the limit of a rank before the shuffle too), so a key of very many rows stays small; a task sorts its rows
    once, which spills, and holds no table of them.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return df.withColumn("_rank", first).where("_rank = 1").select(*keys, *order, *rest)


def clean_capacity(df: DataFrame, order: list[str], prefix: str = "DE_", merged: str = "DE") -> DataFrame:
    """Merge split codes, keep the first of duplicated records, then drop non-positive capacities."""
    rows = first_per_key(normalise_codes(df, prefix, merged), DEDUPE_KEYS, order)
    return rows.where(F.col("capacity_mw") > 0)


def within(df: DataFrame, codes: list[str]) -> DataFrame:
    """Rows whose both ends are allowed."""
    return df.where(F.col("from_map").isin(codes) & F.col("to_map").isin(codes))


def end_codes(df: DataFrame) -> DataFrame:
    """Distinct codes on either end."""
    return df.select(F.explode(F.array("from_map", "to_map")).alias("code")).distinct()


def excluded_codes(df: DataFrame, codes: list[str]) -> DataFrame:
    return end_codes(df).where(~F.col("code").isin(codes))


def monthly_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.trunc("datetime", "MM").alias("month")).agg(F.count("*").alias("n"))


def capacity_edges(df: DataFrame, how: str = "mean") -> DataFrame:
    """Capacity per directed pair: mean, max or exact median."""
    rows = df.select(F.col("from_map").alias("src"), F.col("to_map").alias("dst"), "capacity_mw")
    if how == "median":
        # The quantiles read their input more than once; the joins behind it run only once.
        rows = cut(rows)
        return exact_quantiles(rows, ["src", "dst"], "capacity_mw", {"capacity_mw": 0.5})
    agg = {"mean": F.avg, "max": F.max}[how]
    return rows.groupBy("src", "dst").agg(agg("capacity_mw").alias("capacity_mw"))


def node_list(edges: DataFrame) -> DataFrame:
    """Sorted node universe with its index; nodes are a dimension (area codes)."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(
        F.sort_array(F.collect_set("node")).alias("_nodes"))
    return nodes.select(F.posexplode("_nodes").alias("idx", "node"))


def dense_matrix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every ordered pair of the node dimension, absent edges with capacity 0."""
    listed = nodes.agg(F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("_nodes"))
    grid = (
        listed.select("_nodes", F.explode("_nodes").alias("_a"))
        .select(F.col("_a.node").alias("src"), F.explode("_nodes").alias("_b"))
        .select("src", F.col("_b.node").alias("dst"))
    )
    return grid.join(edges, ["src", "dst"], "left").fillna(0.0, ["capacity_mw"])


def binarise(matrix: DataFrame, threshold: float = 500.0) -> DataFrame:
    """Adjacency: capacity at or above the threshold, diagonal 0."""
    linked = (F.col("capacity_mw") >= threshold) & (F.col("src") != F.col("dst"))
    return matrix.withColumn("g0", F.when(linked, 1).otherwise(0))


def submatrix(matrix: DataFrame, countries: DataFrame) -> DataFrame:
    """Rows and columns of the listed countries, in list order (``idx``)."""
    left = countries.select(F.col("idx").alias("i"), F.col("country").alias("src"))
    right = countries.select(F.col("idx").alias("j"), F.col("country").alias("dst"))
    return matrix.join(left, "src").join(right, "dst")


def check_countries(matrix: DataFrame, countries: DataFrame) -> None:
    """Fail when a listed country is no node of the matrix."""
    absent = countries.join(matrix.select(F.col("src").alias("country")).distinct(), "country", "left_anti")
    names = sorted(r.country for r in absent.select("country").collect())
    if names:
        raise ValueError(f"countries without a matrix row: {names}")


def dropped_nodes(matrix: DataFrame, countries: DataFrame) -> DataFrame:
    return matrix.select(F.col("src").alias("country")).distinct().join(countries, "country", "left_anti")


def expand_mask(mask: DataFrame, n_countries: int, n_vars: int) -> DataFrame:
    """Country mask to variable mask: linked countries get full blocks, a country's own block is
    full except its diagonal. Input (i, j, g0) by country index, output (i, j) of allowed cells."""
    steps = F.sequence(F.lit(0), F.lit(n_vars - 1))
    own = mask.sparkSession.range(n_countries).select(
        F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"))
    linked = mask.where((F.col("g0") == 1) & (F.col("i") != F.col("j"))).select("i", "j")
    return (
        linked.unionByName(own)
        .withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps))
        .select(
            (F.col("i") * n_vars + F.col("_a")).alias("i"), (F.col("j") * n_vars + F.col("_b")).alias("j"))
        .where("i <> j")
    )


def vars_per_country(ny: int, n_countries: int) -> int:
    if ny % n_countries:
        raise ValueError(f"{ny} variables are no multiple of {n_countries} countries")
    return ny // n_countries
