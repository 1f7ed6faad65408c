"""Diagnostics of packed draws against straightforward numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltweave.operators import diagnostics as dg

M, N = 3, 41


def packed(spark, x):
    """x: (chains, draws, cells)"""
    rows = [(c, d, [float(v) for v in x[c, d]]) for c in range(x.shape[0]) for d in range(x.shape[1])]
    return spark.createDataFrame(rows, "chain int, draw long, x array<double>")


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    e = rng.normal(size=(M, N, 4))
    x = e.copy()
    for t in range(1, N):
        x[:, t, 0] += 0.8 * x[:, t - 1, 0]
    x[:, :, 1] += np.arange(M)[:, None] * 3.0
    x[:, :, 2] = (x[:, :, 2] > 0.3).astype(float)
    x[:, :, 3] = 2.0
    return x


def acov(x):
    xc = x - x.mean()
    return np.array([xc[: len(x) - k] @ xc[k:] for k in range(len(x))]) / len(x)


def tau(rho, n):
    total, last = 0.0, np.inf
    for m in range((n - 2) // 2):
        p = rho[2 * m + 1] + rho[2 * m + 2]
        if p <= 0:
            break
        last = min(last, p)
        total += last
    return max(1 + 2 * total, 1.0)


def geyer(x):
    if len(x) < 4 or x.var() == 0:
        return float(len(x))
    a = acov(x)
    return len(x) / tau(a / a[0], len(x))


def test_rhat(spark, sample):
    got = {r.cell: r.rhat for r in dg.rhat(packed(spark, sample), "x").collect()}
    for k in range(3):
        w = sample[:, :, k].var(axis=1, ddof=1).mean()
        b = N * sample[:, :, k].mean(axis=1).var(ddof=1)
        assert np.isclose(got[k], np.sqrt(((N - 1) / N * w + b / N) / w))
    assert got[3] == 1.0 and got[1] > 1.5


def test_rhat_needs_two_chains(spark, sample):
    assert {r.rhat for r in dg.rhat(packed(spark, sample[:1]), "x").collect()} == {None}


def test_ess_geyer(spark, sample):
    got = {(r.chain, r.cell): r.ess for r in dg.ess_geyer(packed(spark, sample), ["chain"], "draw", "x").collect()}
    for c in range(M):
        for k in range(4):
            assert np.isclose(got[c, k], geyer(sample[c, :, k]))


def test_ess_multichain(spark, sample):
    got = {r.cell: r.ess for r in dg.ess_multichain(packed(spark, sample), "x").collect()}
    for k in range(3):
        x = sample[:, :, k]
        w, b = x.var(axis=1, ddof=1).mean(), N * x.mean(axis=1).var(ddof=1)
        vh = (N - 1) / N * w + b / N
        rho = 1 - (w - np.mean([acov(x[c]) for c in range(M)], axis=0)) / vh
        assert np.isclose(got[k], M * N / tau(rho, N))
    assert got[3] == M * N
    assert got[1] < 0.2 * M * N


def test_geweke(spark, sample):
    got = {(r.chain, r.cell): r.z for r in dg.geweke(packed(spark, sample), "x", N).collect()}
    n_a, n_b = max(int(N * 0.1), 2), max(int(N * 0.5), 2)
    for c in range(M):
        for k in range(4):
            a, b = sample[c, :n_a, k], sample[c, -n_b:, k]
            se = np.sqrt(a.var(ddof=1) / max(geyer(a), 1) + b.var(ddof=1) / max(geyer(b), 1))
            want = 0.0 if se == 0 else (a.mean() - b.mean()) / se
            assert np.isclose(got[c, k], want), (c, k)


def test_pooled_ess_variants(spark, sample):
    flat = sample.reshape(M * N, 4)
    rows = [(t, [float(v) for v in flat[t]]) for t in range(M * N)]
    pooled = spark.createDataFrame(rows, "pos long, x array<double>")
    n = M * N
    first = {r.cell: r.n_eff for r in dg.ess_initial_positive(pooled, "x", n).collect()}
    second = {r.cell: r.n_eff for r in dg.ess_biased(pooled, "x", n).collect()}
    for k in range(4):
        x = flat[:, k] - flat[:, k].mean()
        if x.var() < 1e-12:
            assert first[k] == n and second[k] == n
            continue
        total = 0.0
        for lag in range(1, min(100, n // 4) + 1):
            r = np.mean(x[: n - lag] * x[lag:]) / x.var()
            if r <= 0:
                break
            total += r
        assert np.isclose(first[k], min(n / (1 + 2 * total), n))
        total = 0.0
        for lag in range(1, n):
            r = (x[: n - lag] @ x[lag:]) / (x @ x)
            if r <= 0:
                break
            total += r
        assert np.isclose(second[k], n / (1 + 2 * total))


def test_one_chain_falls_back_to_its_own_series(spark):
    rng = np.random.default_rng(8)
    x = np.zeros(400)
    for t in range(1, 400):
        x[t] = 0.95 * x[t - 1] + rng.normal()
    draws = spark.createDataFrame([(0, t, [float(v)]) for t, v in enumerate(x)], "chain int, draw long, x array<double>")
    got = dg.ess_multichain(draws, "x").first()
    own = dg.ess_geyer(draws, ["chain"], "draw", "x").first()
    assert np.isclose(got.ess, own.ess) and got.ess < 100 and got.total == 400


def test_frozen_chains_that_disagree_need_no_lags(spark, monkeypatch):
    rows = [(c, t, [float(c), float((t * 7 + c) % 5)]) for c in range(2) for t in range(600)]
    draws = spark.createDataFrame(rows, "chain int, draw long, x array<double>")
    asked = []
    real = dg.lag_products
    monkeypatch.setattr(dg, "lag_products", lambda *a: asked.append(a[5]) or real(*a))
    got = {r.cell: r.ess for r in dg.ess_multichain(draws, "x").collect()}
    assert got[0] == 1200 and asked == [256]
