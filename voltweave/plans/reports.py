"""Report tables. Each takes the operators' results (dimension-sized) and gives one sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


NOTES = {
    "density": "share of admissible edges present",
    "reciprocity": "zero in an acyclic graph",
    "transitivity": "closed out-neighbour pairs",
    "n_strong_cc": "node count in an acyclic graph",
}

GLOSSARY = {
    "G[i, j] = 1": "j drives i",
    "in-degree of i": "number of drivers of i",
    "out-degree of j": "number of nodes j drives",
    "weights": "absolute posterior means",
}


def with_notes(table: DataFrame) -> DataFrame:
    """Attach the reading note of each graph metric."""
    pairs = [F.lit(v) for kv in NOTES.items() for v in kv]
    return table.withColumn("note", F.create_map(*pairs)[F.col("metric")])


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per report table."""
    for name, table in sheets.items():
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def _labelled(table: DataFrame, labels: DataFrame, key: str = "node") -> DataFrame:
    """Attach country names; ``labels`` is (idx, label) or (idx, country)."""
    name = "country" if "country" in labels.columns else "label"
    return table.join(labels.select(F.col("idx").alias(key), F.col(name).alias("country")), key)


def node_sheet(summary: DataFrame, labels: DataFrame, metrics: dict[str, str], digits: int = 6) -> DataFrame:
    """Wide node table with mean and interval per metric, strongest total first."""
    parts = (("mean", "mean"), ("ci_low", "low"), ("ci_high", "high"))
    cols = [
        F.round(F.max(F.when(F.col("metric") == metric, F.col(src))), digits).alias(f"{short}_{out}")
        for short, metric in metrics.items() for src, out in parts
    ]
    wide = _labelled(summary, labels).groupBy("country").agg(*cols)
    return wide.orderBy(F.desc("total_mean"))


def slice_sheet(
    table: DataFrame, key: str, slices: list[str], labels: DataFrame, metrics: dict[str, str],
    sort_by: str, digits: int = 6,
) -> DataFrame:
    """Wide node table with one block of metrics per slice."""
    cols = [
        F.round(F.max(F.when(F.col(key) == s, F.col(metric))), digits).alias(f"{s}_{short}")
        for s in slices for short, metric in metrics.items()
    ]
    return _labelled(table, labels).groupBy("country").agg(*cols).orderBy(F.desc(sort_by))


def exposure_sheet(exposure: DataFrame, labels: DataFrame) -> DataFrame:
    """Exposure per country with shares in percent, largest first."""
    return _labelled(exposure, labels, "i").select(
        "country", "total", "total_wind", "total_solar", "own_wind", "own_solar", "cross_wind", "cross_solar",
        (100.0 * F.col("share_own")).alias("share_own_pct"),
        (100.0 * F.col("share_wind")).alias("share_wind_pct"),
    ).orderBy(F.desc("total"))


def descending_rank(value: str, tie: str):
    """1-based rank by descending value, ties in input order (one row per node or driver)."""
    return F.row_number().over(Window.orderBy(F.desc(value), tie))


def pervasiveness_sheet(table: DataFrame) -> DataFrame:
    return table.withColumn("rank", descending_rank("out_strength", "j")).select(
        F.col("label").alias("exog"), "source_country", "type", "out_strength", "n_targets", "rank"
    ).orderBy("rank")


def cross_comparison(g0: DataFrame, phi: DataFrame, gamma: DataFrame, labels: DataFrame) -> DataFrame:
    """Value and rank of every country in the three networks, best rank first."""
    table = g0.join(phi, "node").join(gamma, "node")
    ranked = table.withColumns({
        f"{n}_rank": descending_rank(n, "node") for n in ("g0", "phi", "gamma")})
    ranks = [F.col(f"{n}_rank") for n in ("g0", "phi", "gamma")]
    return _labelled(ranked, labels).select(
        "country", F.col("g0").alias("g0_out_deg"), "g0_rank", F.col("phi").alias("phi_out_str"), "phi_rank",
        F.col("gamma").alias("gamma_out_str"), "gamma_rank",
        F.greatest(*ranks).alias("max_rank"), F.least(*ranks).alias("min_rank"),
    ).orderBy("min_rank", "g0_rank")


def probability_sheet(counts: DataFrame, lags: list[int]) -> DataFrame:
    """Edges above each threshold, one row per threshold."""

    def cell(graph: str, label: str):
        return F.max(F.when((F.col("graph") == graph) & (F.col("lag_label") == label), F.col("edges")))

    cols = [cell("G0", "total").alias("g0_edges")]
    for short, graph in (("phi", "G_Phi"), ("gamma", "G_Gamma")):
        cols += [cell(graph, f"lag{k}").alias(f"{short}_lag{k}") for k in lags]
        cols.append(cell(graph, "total").alias(f"{short}_total"))
    return counts.groupBy("threshold").agg(*cols).orderBy("threshold")


def kinds_in_order(nodes: DataFrame) -> DataFrame:
    """Distinct kinds in first-seen order."""
    first = nodes.groupBy("kind").agg(F.min("idx").alias("_first"))
    return first.select("kind", (F.row_number().over(Window.orderBy("_first")) - 1).alias("position"))


def resolve_kinds(wanted: str | list[str] | None, available: list[str]) -> list[str]:
    """Requested kinds in order; None or 'all' is every kind; an unknown kind is an error."""
    if wanted is None or wanted == "all":
        return list(available)
    listed = [wanted] if isinstance(wanted, str) else list(wanted)
    unknown = [k for k in listed if k not in available]
    if unknown:
        raise ValueError(f"unknown kinds {unknown}, available {available}")
    return listed


def configuration_rows(draws: DataFrame, ny: int, nx: int, lags: list[int], alpha: float) -> DataFrame:
    """Run configuration as (label, value) rows."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(label).alias("label"), value.alias("value")) for label, value in (
            ("Countries (ny)", F.lit(str(ny))), ("Exogenous (nx)", F.lit(str(nx))), ("Lags", F.lit(str(lags))),
            ("Posterior samples", F.col("_n").cast("string")),
            ("Credible interval", F.lit(f"{round(100 * (1 - alpha))}%")),
            *((label, F.lit(text)) for label, text in GLOSSARY.items()))]))
    return draws.agg(F.count("*").alias("_n")).select(rows.alias("_r")).select("_r.label", "_r.value")
