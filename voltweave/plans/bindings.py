"""The given tables in the role of the operators' inputs.

Events stand in for sub-daily readings, orders for prices, line items for forecasts and transfers,
and embedding vectors for posterior draws (one vector is one packed draw).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.operators.draws import Layout, chain_lengths, indicator

AREAS = [f"A{k}" for k in range(9)]
PRODUCTION = {"view": "Browse", "click": "Browse", "purchase": "Buy"}
N_CHAINS = 4
# One 8 x 8 contemporaneous graph; the same cells as 4 lags of 4 x 4 and as 2 lags of 4 x 8.
G0 = Layout(rows=8, cols=8)
PHI = Layout(rows=4, cols=4, lags=[1, 2, 3, 7])
GAMMA = Layout(rows=4, cols=8, lags=[1, 7])
WIND, SOLAR = [0, 1, 2, 3], [4, 5, 6, 7]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def area_code() -> F.Column:
    return F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string"))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-daily readings: ts, area, production, mw."""
    return table(spark, sf, "events").select(
        "ts", area_code().alias("area"), F.col("event_type").alias("production"), F.col("value").alias("mw"))


def zone_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Zones (nations) and their country (region)."""
    return table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", F.col("n_name").alias("zone"), F.col("r_name").alias("country"))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("idx"), F.col("r_name").alias("country"))


def zone_prices(spark: SparkSession, sf: str) -> DataFrame:
    """ts, zone, country, price."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(zone_dim(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderdate").alias("ts"), "zone", "country", F.col("o_totalprice").alias("price"))
    )


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """ts, zone, price, as a price feed has them."""
    return zone_prices(spark, sf).drop("country")


def zones(spark: SparkSession, sf: str) -> DataFrame:
    return zone_dim(spark, sf).select("zone", "country")


def load_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """ts, area, mw."""
    return zone_prices(spark, sf).select("ts", F.col("country").alias("area"), F.col("price").alias("mw"))


def generation_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """ts, area, mw."""
    items = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_discount")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return (
        items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(zone_dim(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("l_shipdate").alias("ts"), F.col("country").alias("area"),
                (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("mw"))
    )


def region_names() -> list[str]:
    return ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


CAPACITY_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: Line items that one task of the transfer query joins, and one of the deduplication behind it sorts.
TASK_ITEMS = 400_000


def transfer_tasks(spark: SparkSession, sf: str) -> int:
    """Tasks for the transfer records: they follow the line items, whose number the files' footers hold."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf, "lineitem").count() // TASK_ITEMS))


def transfer_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Transfer records from the supplier's nation to the customer's by code, capacity = quantity; the resolution is a
    character's number, so that all but the keys is of fixed width."""
    items = table(spark, sf, "lineitem").select(
        *CAPACITY_ORDER, "l_quantity", "l_returnflag", F.ascii("l_linestatus").alias("resolution_code"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    sellers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("from_code"))
    buyers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("to_code"))
    # Orders meet their buyers first, so the line items are shuffled by order key only. The number of tasks follows that of the
    # line items, so what a task sorts stays the same at any size.
    tasks = transfer_tasks(spark, sf)
    placed = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).repartition(tasks, "o_orderkey")
    return (
        items.repartition(tasks, "l_orderkey").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("o_orderdate").alias("datetime"), "from_code", "to_code", F.col("l_quantity").alias("capacity_mw"),
            F.col("l_returnflag").alias("contract_type"), "resolution_code", *CAPACITY_ORDER)
    )


def with_names(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Rows of ``transfer_codes`` with the names behind their codes: from_map, to_map, resolution."""
    nations = table(spark, sf, "nation")
    for end in ("from", "to"):
        rows = rows.join(nations.select(F.col("n_nationkey").alias(f"{end}_code"), F.col("n_name").alias(f"{end}_map")), f"{end}_code")
    return rows.withColumn("resolution", F.char("resolution_code")).drop("resolution_code")


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    """Transfer records with all their columns."""
    return with_names(spark, sf, transfer_codes(spark, sf)).select(
        "datetime", "from_code", "from_map", "to_code", "to_map", "capacity_mw", "contract_type", "resolution", *CAPACITY_ORDER)


def spread_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean value of every user and event type; days without such an event are gaps."""
    series = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("date"), series.alias("series")).agg(
        F.avg("value").alias("value"))


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()


def daily_by_area(spark: SparkSession, sf: str) -> DataFrame:
    """Dense daily panel: one series per area, summed readings per day."""
    return readings(spark, sf).groupBy(F.to_date("ts").alias("date"), F.col("area").alias("series")).agg(
        F.sum("mw").alias("value"))


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """Packed draws: chain, draw, x (coefficients) and g (edges: x above 0)."""
    v = table(spark, sf, "embeddings").select(
        (F.col("vec_id") % N_CHAINS).cast("int").alias("chain"),
        F.floor(F.col("vec_id") / N_CHAINS).cast("long").alias("draw"),
        F.col("embedding").cast("array<double>").alias("x"))
    return v.withColumn("g", indicator("x"))


def lengths(spark: SparkSession, sf: str) -> list[int]:
    """Draws of every chain; they differ by one where the vectors don't part evenly."""
    return chain_lengths(draws(spark, sf), N_CHAINS)


def n_keep(spark: SparkSession, sf: str) -> int:
    """Draws that every chain has."""
    return table(spark, sf, "embeddings").count() // N_CHAINS


def nation_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("idx"), F.col("n_name").alias("label"))


def exog(spark: SparkSession, sf: str) -> DataFrame:
    """Driver dimension of GAMMA: the region of column j % 4, wind first, then solar."""
    kinds = F.explode(F.array(
        F.struct(F.lit("wind").alias("type"), F.lit(0).alias("shift")),
        F.struct(F.lit("solar").alias("type"), F.lit(4).alias("shift"))))
    return regions(spark, sf).where(F.col("idx") < GAMMA.rows).select("idx", "country", kinds.alias("_k")).select(
        (F.col("idx") + F.col("_k.shift")).alias("j"),
        F.concat_ws("_", "country", "_k.type").alias("label"),
        F.col("idx").alias("country_idx"), F.col("country").alias("source_country"), "_k.type")
