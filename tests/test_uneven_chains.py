"""Chains that differ in length: a number of vectors that four chains don't share evenly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, difference
from voltweave.operators import diagnostics as dg
from voltweave.operators.draws import chain_lengths, check_chains, pooled
from voltweave.sources import npy, tables
from voltweave.sources.chunks import ChunkStore

N = 102  # chains of 26, 26, 25 and 25 draws


def vectors(n=N):
    return np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("uneven")
    rows = [(k, x.tolist()) for k, x in enumerate(vectors())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(path / "made"))
    spark.read.parquet(str(path / "made")).coalesce(1).write.parquet(str(path / "embeddings"))
    (next((path / "embeddings").glob("part-*.parquet"))).rename(path / "embeddings.parquet")
    for name in ("region", "nation"):
        (path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    return str(path)


def uneven(spark):
    return spark.createDataFrame([(c, d, float(10 * c + d)) for c, n in enumerate((4, 4, 3)) for d in range(n)], "chain int, draw long, x double")


@pytest.mark.parametrize("name", [
    "s12_npy_scan", "s13_checked_chains", "k5_draw_store", "k5_resumed_store", "w13_ess_multichain", "r12_dashboard"])
def test_queries_equal_their_sql(spark, sf, name):
    assert difference(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name]) == ""


def test_pooled_positions_are_dense(spark):
    d = uneven(spark)
    assert chain_lengths(d, 4) == [4, 4, 3, 0]
    got = pooled(d, [4, 4, 3]).orderBy("chain", "draw").collect()
    assert [r.pos for r in got] == list(range(11))
    assert check_chains(d, 3, uneven=True) == 4
    with pytest.raises(FileNotFoundError):
        check_chains(d, 4, uneven=True)


@pytest.mark.parametrize("name", ["j10_pooled_position", "s14_npy_quantity"])
def test_pooled_queries_use_each_position_once(spark, sf, name):
    got = entry.queries()[name](spark, sf).orderBy("chain", F.col("pos")).collect()
    assert [r.pos for r in got] == list(range(N))
    assert [r.chain for r in got] == [0] * 26 + [1] * 26 + [2] * 25 + [3] * 25


def rho_of(g, lags):
    y = g - g.mean(axis=0)
    return {(c, k): (y[k:, c] * y[: len(y) - k, c]).sum() / (len(y) - k) / (y[:, c] ** 2).mean() for c in range(64) for k in lags}


def test_pooled_diagnostics_equal_numpy(spark, sf):
    x = vectors()
    g = (np.concatenate([x[c::4] for c in range(4)]) > 0).astype(float)
    want = rho_of(g, range(1, 21))
    got = {(r.cell, r.lag): r.rho for r in entry.queries()["w8_autocorrelation"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    ess = {}
    for c in range(64):
        total = 0.0
        for k in range(1, N // 4 + 1):
            if (r := rho_of(g[:, [c] * 64], [k])[0, k]) <= 0:
                break
            total += r
        ess[c] = min(N / (1 + 2 * total), N)
    found = {r.cell: r.n_eff for r in entry.queries()["w10_ess_initial_positive"](spark, sf).collect()}
    assert all(abs(found[c] - ess[c]) < 1e-3 for c in range(64))
    edges = {(r.i, r.j): r.n_eff for r in entry.queries()["g16_edge_analysis"](spark, sf).collect() if r.admissible}
    assert len(edges) == 56 and all(abs(v - ess[8 * i + j]) < 1e-3 for (i, j), v in edges.items())


@pytest.mark.parametrize("name", ["w11_ess_biased", "f12_credible_mask", "a34_slice_counts", "t2_top_edges", "r4_g0_edges", "g16_gamma_edges"])
def test_other_pooled_queries_run(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_stores_keep_every_draw(spark, tmp_path):
    d = uneven(spark)
    rows = sorted(map(tuple, d.collect()))
    npy.write_samples(d, str(tmp_path / "npy"), {"x": ()}).collect()
    with pytest.raises(ValueError, match="length"):
        npy.headers(str(tmp_path / "npy"), 3)
    for size in (2, 4096):
        assert sorted(map(tuple, npy.read_samples(spark, str(tmp_path / "npy"), 3, rows=size, uneven=True).collect())) == rows
    tables.write_draws(d, str(tmp_path / "draws"))
    with pytest.raises(ValueError, match="length"):
        tables.read_draws(spark, str(tmp_path / "draws"), 3)
    assert tables.read_draws(spark, str(tmp_path / "draws"), 3, uneven=True).count() == 11

    make = lambda a, b: d.where((F.col("draw") >= a) & (F.col("draw") < b))
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    assert [(c.stop, c.rows) for c in store.run(make, [4, 4, 3], 3, 3)] == [(3, 9), (4, 2)]
    assert sorted(map(tuple, store.read().collect())) == rows
    moved = d.where("NOT (chain = 0 AND draw = 3)").unionByName(d.limit(0).unionByName(spark.createDataFrame([(2, 3, 0.0)], d.schema)))
    with pytest.raises(ValueError, match="chunk 0"):
        ChunkStore(spark, str(tmp_path / "bad")).run(lambda a, b: moved, [4, 4, 3], 4, 3)


def test_short_chains_are_one_series(spark):
    d = uneven(spark).where("chain > 1 OR draw < 3").where("chain < 2 OR draw < 2").withColumn("x", F.array("x"))
    row = dg.ess_multichain(d, "x").first()
    assert row.total == 8 and row.ess > 0
