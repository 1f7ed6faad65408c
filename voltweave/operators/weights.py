"""Weighted networks from posterior mean coefficients. All tables hold one row per cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltweave.functions.columns import clip, keep_above
from voltweave.operators import kernels


def weight_matrices(means: DataFrame, threshold: float = 0.0) -> DataFrame:
    """|posterior mean| per lag and summed over lags; the threshold applies before summing."""
    w = keep_above(F.col("mean"), threshold)
    slices = F.explode(F.array(F.concat(F.lit("lag"), F.col("lag").cast("string")), F.lit("agg")))
    return means.select("i", "j", w.alias("w"), slices.alias("slice")).groupBy("slice", "i", "j").agg(
        F.sum("w").alias("w"))


def strengths(weights: DataFrame, keys: list[str]) -> DataFrame:
    """In-, out- and total strength per node of square matrices, self-loops included."""
    ends = F.explode(F.array(
        F.struct(F.col("i").alias("node"), F.col("w").alias("_in"), F.lit(0.0).alias("_out")),
        F.struct(F.col("j").alias("node"), F.lit(0.0).alias("_in"), F.col("w").alias("_out"))))
    return (
        weights.select(*keys, ends.alias("_e")).groupBy(*keys, F.col("_e.node").alias("node"))
        .agg(F.sum("_e._in").alias("in_strength"), F.sum("_e._out").alias("out_strength"))
        .withColumn("total_strength", F.col("in_strength") + F.col("out_strength"))
    )


def gini(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Gini of the positive off-diagonal weights; NULL below two. One matrix per window."""
    w = Window.partitionBy(*keys).orderBy("w")
    ranked = weights.where("i <> j AND w > 0").withColumn("_cum", F.sum("w").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n, total = F.count("*"), F.max("_cum")
    value = (n + 1 - 2.0 * F.sum("_cum") / total) / n
    return ranked.groupBy(*keys).agg(F.when(n >= 2, value).alias("weight_gini"))


def graph_level(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Total weight (with diagonal), off-diagonal mean and density, and Gini per matrix."""
    off = F.col("i") != F.col("j")
    level = weights.groupBy(*keys).agg(
        F.sum("w").alias("total_weight"),
        F.avg(F.when(off, F.col("w"))).alias("mean_weight_off_diag"),
        F.avg(F.when(off, (F.col("w") > 0).cast("double"))).alias("weight_density"))
    return level.join(gini(weights, keys), keys, "left")


def node_paths(weights: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Centrality and 1/weight betweenness per node. A group is one n x n matrix."""
    fields = ", ".join(f"{weights.schema[k].name} {weights.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        w = np.zeros((n, n))
        w[table.column("i").to_numpy(), table.column("j").to_numpy()] = table.column("w").to_numpy()
        eigen = kernels.centrality(w[None], max_iter=500)[0]
        between = kernels.weighted_betweenness(w)
        names = [*keys, "node", "eigen", "between"]
        return pa.table(
            [pa.array([k.as_py()] * n, type=k.type) for k in key]
            + [pa.array(np.arange(n, dtype=np.int32)), pa.array(eigen), pa.array(between, from_pandas=True)],
            names=names)

    return weights.select(*keys, "i", "j", "w").groupBy(*keys).applyInArrow(
        run, f"{fields}, node int, eigen double, between double")


def node_metrics(weights: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Every node metric of the weight matrices."""
    return strengths(weights, keys).join(node_paths(weights, keys, n), [*keys, "node"])


def exposure(weights: DataFrame, exog: DataFrame) -> DataFrame:
    """Per response country: own/cross and wind/solar totals and shares (0 without exposure).

    ``exog`` is the driver dimension (j, label, country_idx, type).
    """
    rows = weights.join(exog, "j").withColumn("own", F.col("country_idx") == F.col("i"))

    def part(own: bool, kind: str):
        hit = (F.col("own") == own) & (F.col("type") == kind)
        return F.sum(F.when(hit, F.col("w")).otherwise(0.0))

    table = rows.groupBy("i").agg(
        part(True, "wind").alias("own_wind"), part(True, "solar").alias("own_solar"),
        part(False, "wind").alias("cross_wind"), part(False, "solar").alias("cross_solar"))
    table = table.withColumns({
        "total_wind": F.col("own_wind") + F.col("cross_wind"),
        "total_solar": F.col("own_solar") + F.col("cross_solar")})
    table = table.withColumn("total", F.col("total_wind") + F.col("total_solar"))
    return table.withColumns({
        "share_own": F.coalesce(F.try_divide(F.col("own_wind") + F.col("own_solar"), F.col("total")), F.lit(0.0)),
        "share_wind": F.coalesce(F.try_divide(F.col("total_wind"), F.col("total")), F.lit(0.0))})


def pervasiveness(weights: DataFrame, exog: DataFrame) -> DataFrame:
    """Per driver: total outgoing weight and number of countries reached."""
    return weights.groupBy("j").agg(
        F.sum("w").alias("out_strength"), F.count_if(F.col("w") > 0).alias("n_targets")
    ).join(exog, "j")


def country_networks(weights: DataFrame, exog: DataFrame) -> DataFrame:
    """Driver weights collapsed to their country: networks wind, solar and combined."""
    rows = weights.join(exog.select("j", "country_idx", "type"), "j")
    nets = F.explode(F.array(F.col("type"), F.lit("combined")))
    sums = rows.select("i", F.col("country_idx").alias("j"), nets.alias("network"), "w").groupBy(
        "network", "i", "j").agg(F.sum("w").alias("w"))
    return sums


def square_block(means: DataFrame, exog: DataFrame, kind: str) -> DataFrame:
    """One driver type placed on country columns, diagonal masked (no self-loops)."""
    drivers = exog.where(F.col("type") == kind).select("j", "country_idx")
    return means.join(drivers, "j").select(
        "lag", "i", F.col("country_idx").alias("j"), F.col("mean").alias("coef")).where("i <> j")


def kind_flows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted degrees and net flow per node, over edges within the node's own kind.

    ``nodes`` is (label, kind); every node is kept.
    """
    a = nodes.select(F.col("label").alias("source"), F.col("kind").alias("_ks"))
    b = nodes.select(F.col("label").alias("target"), F.col("kind").alias("_kt"))
    inside = edges.join(a, "source").join(b, "target").where("_ks = _kt")
    out = inside.groupBy(F.col("source").alias("label")).agg(F.sum("weight").alias("_o"))
    into = inside.groupBy(F.col("target").alias("label")).agg(F.sum("weight").alias("_i"))
    flows = nodes.join(out, "label", "left").join(into, "label", "left").fillna(0.0, ["_o", "_i"])
    return flows.select("label", "kind", F.col("_i").alias("in_degree"), F.col("_o").alias("out_degree"),
                        (F.col("_o") - F.col("_i")).alias("net_flow"))


def cross_kind_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Number of edges that join two kinds (shown by no single-kind view)."""
    a = nodes.select(F.col("label").alias("source"), F.col("kind").alias("_ks"))
    b = nodes.select(F.col("label").alias("target"), F.col("kind").alias("_kt"))
    return edges.join(a, "source").join(b, "target").agg(
        F.count_if(F.col("_ks") != F.col("_kt")).alias("n_cross"))


def coefficient_flows(coefs: DataFrame, nodes: DataFrame, min_abs: float = 0.0) -> DataFrame:
    """Signed and absolute strengths per node from coefficients (i, j, coef) within one kind.

    ``nodes`` is (idx, label, kind); self-loops and |coef| <= min_abs are ignored.
    """
    a = nodes.select(F.col("idx").alias("j"), F.col("kind").alias("_kd"))
    b = nodes.select(F.col("idx").alias("i"), F.col("kind").alias("_kr"))
    edges = coefs.where((F.col("i") != F.col("j")) & (F.abs("coef") > min_abs)).join(a, "j").join(b, "i").where(
        "_kd = _kr")
    ends = F.explode(F.array(
        F.struct(F.col("j").alias("idx"), F.abs("coef").alias("oa"), F.lit(0.0).alias("ia"),
                 F.col("coef").alias("os"), F.lit(0.0).alias("is_")),
        F.struct(F.col("i").alias("idx"), F.lit(0.0).alias("oa"), F.abs("coef").alias("ia"),
                 F.lit(0.0).alias("os"), F.col("coef").alias("is_"))))
    sums = edges.select(ends.alias("_e")).groupBy("_e.idx").agg(
        F.sum("_e.oa").alias("out_strength"), F.sum("_e.ia").alias("in_strength"),
        F.sum(F.col("_e.os") - F.col("_e.is_")).alias("net_flow_signed"))
    return nodes.join(sums, "idx", "left").fillna(
        0.0, ["out_strength", "in_strength", "net_flow_signed"]
    ).withColumn("net_flow_abs", F.col("out_strength") - F.col("in_strength"))


def top_transmitters(flows: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k strongest transmitters of each kind (nodes are a dimension; ties by label)."""
    w = Window.partitionBy("kind").orderBy(F.desc(by), "label")
    return flows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def edge_styles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Line width and opacity per edge within one kind, scaled by that kind's probabilities."""
    a = nodes.select(F.col("label").alias("source"), F.col("kind").alias("_ks"))
    b = nodes.select(F.col("label").alias("target"), F.col("kind").alias("_kt"))
    inside = edges.join(a, "source").join(b, "target").where("_ks = _kt")
    w = Window.partitionBy("_ks")
    low, high = F.min("weight").over(w), F.max("weight").over(w)
    width = F.when(high > low, 0.7 + 2.6 * (F.col("weight") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(1.8)
    return inside.select(
        "source", "target", width.alias("width"),
        clip(0.45 + 0.45 * (F.col("weight") - 0.5) / 0.5, 0.45, 0.9).alias("alpha"))
