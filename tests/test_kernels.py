"""Kernels against hand-made graphs and brute force."""

from itertools import permutations

import numpy as np
import pytest

from voltweave.operators import kernels
from voltweave.operators.impute import not_a_knot


def graph(n, edges):
    g = np.zeros((n, n))
    for src, dst in edges:
        g[dst, src] = 1
    return g


def brute_betweenness(w):
    """Enumerate all simple paths of a small graph; edge length 1 / weight."""
    n = len(w)
    score = np.zeros(n)
    for s in range(n):
        for t in range(n):
            if s == t:
                continue
            paths = []
            others = [v for v in range(n) if v not in (s, t)]
            for r in range(len(others) + 1):
                for mid in permutations(others, r):
                    walk = (s, *mid, t)
                    if all(w[b, a] > 0 for a, b in zip(walk, walk[1:])):
                        paths.append((sum(1 / w[b, a] for a, b in zip(walk, walk[1:])), mid))
            if paths:
                low = min(p[0] for p in paths)
                short = [m for c, m in paths if c <= low + 1e-12]
                for m in short:
                    for v in m:
                        score[v] += 1 / len(short)
    return score / ((n - 1) * (n - 2))


@pytest.mark.parametrize("seed", range(6))
def test_betweenness_matches_enumeration(seed):
    rng = np.random.default_rng(seed)
    g = (rng.random((4, 5, 5)) < 0.4).astype(float)
    got = kernels.betweenness(g)
    for b in range(4):
        want = brute_betweenness(g[b])
        assert np.allclose(got[b], want)
        assert np.allclose(kernels.weighted_betweenness(g[b]), want)


def test_weighted_betweenness_prefers_strong_edges():
    w = np.zeros((5, 5))
    w[1, 0], w[2, 1], w[2, 0], w[3, 2] = 4, 4, 1, 2
    assert np.allclose(kernels.weighted_betweenness(w), brute_betweenness(w))
    assert np.isnan(kernels.weighted_betweenness(np.eye(3))).all()


def test_small_graph_invariants():
    dag = graph(4, [(0, 1), (0, 2), (1, 2), (2, 3)])
    cycle = graph(4, [(0, 1), (1, 2), (2, 0)])
    empty = np.zeros((4, 4))
    loop = graph(4, [(1, 1)])
    batch = np.stack([dag, cycle, empty, loop])
    assert kernels.acyclic(batch).tolist() == [True, False, True, False]
    assert kernels.strong_components(batch).tolist() == [4, 2, 4, 4]
    t = kernels.transitivity(batch)
    # dag: node 0 has out-neighbours {1, 2} with 1->2: one closed pair of two ordered pairs.
    assert t[0] == 0.5 and t[1] == 0.0 and np.isnan(t[2])
    b = kernels.betweenness(batch)
    assert np.isnan(b[2]).all()
    assert np.allclose(kernels.centrality(batch)[2], 0.25)


def test_centrality_is_the_fixed_point():
    rng = np.random.default_rng(0)
    w = rng.random((3, 6, 6)) * (rng.random((3, 6, 6)) < 0.5)
    x = kernels.centrality(w, max_iter=1000)
    for b in range(3):
        col = w[b].sum(axis=0)
        m = w[b] / np.where(col == 0, 1, col)
        want = np.linalg.solve(np.eye(6) - 0.85 * m, np.full(6, 0.15 / 6))
        assert np.allclose(x[b], want, atol=1e-8)


def test_spectral_radius_single_lag_and_companion():
    phi = np.diag([0.5, -0.9])[None, None]
    assert np.isclose(kernels.spectral_radius(phi)[0], 0.9)
    # y_t = 0.5 y_{t-1} + 0.3 y_{t-2}: root of z^2 - 0.5 z - 0.3
    two = np.array([0.5, 0.3]).reshape(1, 2, 1, 1)
    assert np.isclose(kernels.spectral_radius(two)[0], max(abs(np.roots([1, -0.5, -0.3]))))


def test_structural_coefficients_recover_the_model():
    b0 = np.array([[0, 0, 0], [0.7, 0, 0], [-0.2, 0.5, 0]])
    inv = np.linalg.inv(np.eye(3) - b0)
    sigma = inv @ np.diag([1.0, 2.0, 0.5]) @ inv.T
    got, eps = kernels.structural(sigma[None], (b0 != 0).astype(float)[None])
    assert np.allclose(got[0], b0) and np.allclose(eps[0], [1.0, 2.0, 0.5])


@pytest.mark.parametrize("knots", [[0, 1, 2, 8, 9, 12], [0, 3, 4, 5], [0, 1, 2, 3, 4, 10, 11, 12, 20]])
def test_spline_restores_a_cubic(knots):
    x = np.array(knots, float)
    at = np.linspace(x[0], x[-1], 23)
    f = lambda t: 0.3 * t**3 - t**2 + 4
    assert np.allclose(not_a_knot(x, f(x), at), f(at))
    assert np.isnan(not_a_knot(x, f(x), np.array([-1.0, 99.0]))).all()


def test_spline_is_smooth_and_interpolates():
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.integers(1, 4, 12)).astype(float)
    y = rng.normal(size=12)
    assert np.allclose(not_a_knot(x, y, x), y)
    for k in x[1:-1]:
        d = lambda s: np.diff(not_a_knot(x, y, k + s * np.array([0, 1e-4])))[0] / (s * 1e-4)
        assert abs(d(1) - d(-1)) < 1e-2
