"""Autocovariances at all lags against plain sums."""

import numpy as np
import pandas as pd
import pytest

from voltweave.operators import diagnostics as dg
from voltweave.operators import spectra


def frame(spark, chains):
    rows = [(c, t, v.tolist()) for c, x in chains.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "chain int, draw long, x array<double>")


def plain(x):
    x = x - x.mean(axis=0)
    return [[(x[: len(x) - k, c] * x[k:, c]).sum() for c in range(x.shape[1])] for k in range(len(x))]


@pytest.mark.parametrize("group", [4, 64, 8192])
def test_all_lags_equal_sums(spark, monkeypatch, group):
    monkeypatch.setattr(spectra, "GROUP", group)
    r = np.random.default_rng(1)
    chains = {0: r.normal(size=(150, 3)), 1: np.cumsum(r.normal(size=(37, 3)), axis=0), 2: np.ones((1, 3)), 3: r.normal(size=(2, 3)), 4: np.full((40, 3), 5.0)}
    got = spectra.all_autocovariance_sums(frame(spark, chains).repartition(5), ["chain"], "draw", "x").collect()
    assert len(got) == sum(x.size for x in chains.values())
    known = {c: plain(x) for c, x in chains.items()}
    for row in got:
        assert row.n == len(chains[row.chain])
        assert abs(row.s - known[row.chain][row.lag][row.cell]) < 1e-8, row


def test_long_chain(spark):
    """All lags of 200 000 draws; the plain sums at some of them."""
    n = 200_000
    x = np.cumsum(np.random.default_rng(2).normal(size=n)) / 100
    df = spark.range(n).selectExpr("0 AS chain", "id AS draw")
    values = spark.createDataFrame(
        pd.DataFrame({"draw": np.arange(n), "v": x})).selectExpr("draw", "array(v, -2 * v) AS x")
    found = dg.autocovariances(df.join(values, "draw"), "x")
    wanted = [0, 1, 511, 512, 99_999, 199_998, 199_999]
    got = {(r.lag, r.cell): r.acov for r in found.where(found.lag.isin(wanted)).collect()}
    d = x - x.mean()
    for k in wanted:
        s = (d[: n - k] * d[k:]).sum() / n
        assert abs(got[k, 0] - s) < 1e-8 and abs(got[k, 1] - 4 * s) < 1e-8
    assert found.count() == 2 * n


def test_positions_are_checked(spark):
    df = spark.createDataFrame([(0, 0, [1.0]), (0, 2, [2.0])], "chain int, draw long, x array<double>")
    with pytest.raises(ValueError, match="dense"):
        spectra.all_autocovariance_sums(df, ["chain"], "draw", "x")
    assert spectra.all_autocovariance_sums(df.limit(0), ["chain"], "draw", "x").collect() == []


def test_grid_holds_twice_the_length():
    for n in (1, 2, 3, 4, 5, 100, 4096, 4097, 10**6):
        a, b = spectra._grid(n)
        assert a * b >= 2 * n and a <= b <= 2 * a
