"""Graph and weight operators on tiny hand-made matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltweave.functions import columns as fc
from voltweave.operators import edges as ed
from voltweave.operators import graphs as gr
from voltweave.operators import network
from voltweave.operators import weights as wt
from voltweave.operators.draws import Layout, cell_average, check_chains, driver_scalars, indicator, pooled, trace
from voltweave.plans.reports import resolve_kinds


def draws(spark, mats):
    """One draw per matrix, chain 0."""
    return spark.createDataFrame(
        [(0, k, [float(v) for v in np.ravel(m)]) for k, m in enumerate(mats)], "chain int, draw long, g array<double>")


def edge_frame(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


def weights(spark, w, name="n"):
    rows = [(name, i, j, float(w[i][j])) for i in range(len(w)) for j in range(len(w))]
    return spark.createDataFrame(rows, "slice string, i int, j int, w double")


def test_degrees_density_reciprocity(spark):
    recip = np.zeros((3, 3))
    recip[0, 1] = recip[1, 0] = recip[2, 0] = 1
    got = gr.degree_metrics(draws(spark, [recip, np.zeros((3, 3))]), "g", 3, 6).orderBy("draw").collect()
    assert got[0].in_degree == [1, 1, 1] and got[0].out_degree == [2, 1, 0] and got[0].total_degree == [3, 2, 1]
    assert got[0].density == 0.5 and got[0].reciprocity == pytest.approx(2 / 3)
    assert got[1].density == 0 and got[1].reciprocity is None


def test_acyclic_graph_invariants(spark):
    dag = np.zeros((4, 4))
    dag[1, 0] = dag[2, 0] = dag[2, 1] = dag[3, 2] = 1
    d = draws(spark, [dag])
    m = gr.draw_metrics(d, "g", 4).first()
    assert m.acyclic and m.n_strong_cc == 4 and m.transitivity == 0.5
    assert gr.degree_metrics(d, "g", 4, 12).first().reciprocity == 0.0
    skipped = gr.draw_metrics(d, "g", 4, with_betweenness=False).first()
    assert skipped.between is None
    summary = gr.graph_summary(gr.draw_metrics(draws(spark, [dag, 0 * dag]), "g", 4), ["transitivity"]).first()
    assert summary["mean"] == 0.5


def test_relational_reachability(spark):
    assert gr.is_dag(edge_frame(spark, [(0, 1), (1, 2), (0, 2)]))
    assert not gr.is_dag(edge_frame(spark, [(0, 1), (1, 2), (2, 0)]))
    assert not gr.is_dag(edge_frame(spark, [(1, 1)]))
    chain = [(k, k + 1) for k in range(9)]
    assert gr.reachability(edge_frame(spark, chain), []).count() == 45
    nodes = spark.createDataFrame([(k,) for k in range(5)], "node int")
    two = edge_frame(spark, [(0, 1), (1, 0), (2, 3), (3, 4), (4, 2), (1, 2)])
    assert gr.component_count(two, nodes).first().n_strong_cc == 2


def test_star_weights(spark):
    w = np.zeros((5, 5))
    w[1, 0], w[2, 0], w[3, 0], w[0, 0] = 1, 2, 4, 3
    table = weights(spark, w)
    level = wt.graph_level(table, ["slice"]).first()
    assert level.total_weight == 10 and level.mean_weight_off_diag == pytest.approx(7 / 20)
    assert level.weight_density == pytest.approx(3 / 20)
    cum = np.cumsum([1, 2, 4])
    assert level.weight_gini == pytest.approx((4 - 2 * cum.sum() / 7) / 3)
    s = {r.node: (r.in_strength, r.out_strength, r.total_strength) for r in wt.strengths(table, ["slice"]).collect()}
    assert s[0] == (3, 10, 13) and s[3] == (4, 0, 4) and s[4] == (0, 0, 0)
    nodes = {r.node: r for r in wt.node_metrics(table, ["slice"], 5).collect()}
    assert nodes[0].between == 0 and nodes[4].eigen == pytest.approx(0.03)
    one = wt.graph_level(weights(spark, [[0, 1], [0, 0]]), ["slice"]).first()
    assert one.weight_gini is None


def test_threshold_applies_before_the_lag_sum(spark):
    means = spark.createDataFrame([(1, 0, 1, 0.4), (7, 0, 1, -0.2), (1, 1, 0, 0.05), (7, 1, 0, 0.05)],
                                  "lag int, i int, j int, mean double")
    got = {(r.slice, r.i, r.j): r.w for r in wt.weight_matrices(means, 0.1).collect()}
    assert got["agg", 0, 1] == pytest.approx(0.6) and got["agg", 1, 0] == 0 and got["lag7", 0, 1] == 0.2


def test_exposure_shares(spark):
    exog = spark.createDataFrame(
        [(0, "A_wind", 0, "A", "wind"), (1, "B_wind", 1, "B", "wind"), (2, "A_solar", 0, "A", "solar")],
        "j int, label string, country_idx int, source_country string, type string")
    w = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 5.0), (1, 0, 0.0), (1, 1, 0.0), (1, 2, 0.0)],
                              "i int, j int, w double")
    got = {r.i: r for r in wt.exposure(w, exog).collect()}
    assert (got[0].own_wind, got[0].own_solar, got[0].cross_wind, got[0].cross_solar) == (1, 5, 2, 0)
    assert got[0].share_own == 0.75 and got[0].share_wind == pytest.approx(3 / 8)
    assert got[1].total == 0 and got[1].share_own == 0 and got[1].share_wind == 0
    p = {r.label: (r.out_strength, r.n_targets) for r in wt.pervasiveness(w, exog).collect()}
    assert p == {"A_wind": (1, 1), "B_wind": (2, 1), "A_solar": (5, 1)}
    nets = {(r.network, r.i, r.j): r.w for r in wt.country_networks(w, exog).collect()}
    assert nets["combined", 0, 0] == 6 and nets["wind", 0, 1] == 2 and nets["solar", 0, 0] == 5


def test_edge_table_constant_cells_and_mask(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (40, 2, 2)).astype(float)
    x[:, 0, 1] = 1.0
    d = draws(spark, x).withColumn("chain", (F.col("draw") / 20).cast("int")).withColumn("draw", F.col("draw") % 20)
    assert check_chains(d, 2) == 20
    t = {(r.i, r.j): r for r in ed.edge_table(d, "g", Layout(2, 2), 20, 2, "i <> j").collect()}
    assert t[0, 1].edge_prob == 1 and t[0, 1].n_eff == 40 and t[0, 1].ci_lower == 1 and t[0, 1].selected_credible
    assert t[0, 0].edge_prob == 0 and t[0, 0].n_eff is None and not t[0, 0].selected_naive
    r = t[1, 0]
    assert 0 <= r.ci_lower <= r.edge_prob <= 1
    with pytest.raises(FileNotFoundError):
        check_chains(d, 3)
    with pytest.raises(ValueError):
        check_chains(d.where("chain = 0 OR draw < 5"), 2)
    assert [r.pos for r in pooled(d, 20).orderBy("pos").collect()] == list(range(40))


def test_packed_expressions(spark):
    d = draws(spark, [np.arange(9) - 4.0]).withColumn("pos", indicator("g"))
    row = d.select("pos", trace("g", 3).alias("tr")).first()
    assert row.pos == [0] * 5 + [1] * 4 and row.tr == 0
    row = driver_scalars(d, "g", "pos", Layout(3, 3), {"wind": [0, 2]}, "G").first()
    assert row.G_wind_max == 4 and row.G_wind_active == 3
    assert row.G_wind_norm == pytest.approx(np.sqrt(16 + 4 + 1 + 1 + 4 + 16))
    mean = {(r.lag, r.i, r.j): r["mean"] for r in cell_average(draws(spark, [np.arange(4), np.arange(4) + 2]), "g", Layout(1, 2, [1, 7])).collect()}
    assert mean == {(1, 0, 0): 1, (1, 0, 1): 2, (7, 0, 0): 3, (7, 0, 1): 4}


def test_mask_expansion(spark):
    m = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (0, 0, 0), (1, 1, 0)], "i int, j int, g0 int")
    got = {(r.i, r.j) for r in network.expand_mask(m, 2, 2).collect()}
    assert got == {(0, 1), (1, 0), (2, 3), (3, 2), (0, 2), (0, 3), (1, 2), (1, 3)}
    assert network.vars_per_country(56, 28) == 2
    with pytest.raises(ValueError):
        network.vars_per_country(57, 28)


def test_scalar_columns(spark):
    df = spark.createDataFrame([("DE_Price_x", 0.0), ("FR_Load", 1.0)], "n string, p double")
    rows = df.select(fc.country_of(F.col("n")).alias("c"), fc.kind_of(F.col("n")).alias("k"),
                     fc.bernoulli_kl(F.col("p")).alias("kl"), fc.ratio(F.lit(1.0), F.col("p")).alias("r")).collect()
    assert [(r.c, r.k) for r in rows] == [("DE", "Price_x"), ("FR", "Load")]
    assert rows[0].kl == pytest.approx(np.log(2), abs=1e-6) and rows[0].r is None
    with pytest.raises(Exception, match="CC_KIND"):
        spark.createDataFrame([("DE",)], "n string").select(fc.kind_of(F.col("n"))).collect()
    lights = spark.createDataFrame([(0.005, -3.5, 1.2), (0.02, 2.5, 1.02), (0.5, 0.1, 1.0)], "e double, z double, r double").select(
        fc.ess_light(F.col("e")), fc.geweke_light(F.col("z")), fc.rhat_light(F.col("r"))).collect()
    assert [tuple(r) for r in lights] == [("red",) * 3, ("amber",) * 3, ("green",) * 3]


def test_kind_resolution():
    assert resolve_kinds(None, ["a", "b"]) == ["a", "b"] and resolve_kinds("b", ["a", "b"]) == ["b"]
    with pytest.raises(ValueError):
        resolve_kinds(["c"], ["a"])
