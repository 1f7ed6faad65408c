"""Scores of blocks and parent sets, gains of toggles and reduced forms against plain linear algebra."""

import itertools

import numpy as np
import pytest

from voltweave.operators import kernels
from voltweave.operators import scores as sc
from voltweave.operators.bayes import BlockScore


@pytest.fixture(scope="module")
def model():
    x = np.random.default_rng(1).normal(size=(60, 9))
    x[:, 4] += x[:, 1]
    x[:, 7] -= 2 * x[:, 1] + x[:, 2]
    score = BlockScore.of(15.0, 9, 60)
    return x.T @ x + score.c0 * np.eye(9), score


def test_masked_log_determinants(model):
    post, _ = model
    blocks = [(), (3,), (0, 8), (8, 0), (1, 4, 7), tuple(range(9))]
    rows = np.array([[*b, *[-1] * (9 - len(b))] for b in blocks])
    got = sc.masked_log_determinants(post, rows)
    known = [np.linalg.slogdet(post[np.ix_(b, b)])[1] if b else 0.0 for b in blocks]
    np.testing.assert_allclose(got, known, atol=1e-10)


def test_block_marginals_of_every_size(spark, model):
    post, score = model
    blocks = [list(c) for n in range(6) for c in itertools.combinations(range(9), n)]
    df = spark.createDataFrame([(k, b, "x") for k, b in enumerate(blocks)], "k int, block array<int>, offset string").repartition(3)
    rows = sc.block_marginals(df, post, score).collect()
    assert len(rows) == len(blocks) and rows[0].offset == "x"
    for r in rows:
        assert abs(r.log_marginal - score.log_marginal(post, r.block)) < 1e-9


def test_local_scores_of_draws(spark, model):
    post, score = model
    r = np.random.default_rng(2)
    graphs = [(c, d, (r.random(81) < 0.4).astype(float).tolist()) for c in range(2) for d in range(20)] + [(0, 20, [0.0] * 81), (0, 21, [1.0] * 81)]
    draws = spark.createDataFrame(graphs, "chain int, draw long, g array<double>")
    known = {}
    for c, d, g in graphs:
        for i in range(9):
            parents = [j for j in range(9) if j != i and g[i * 9 + j]]
            known[c, d, i] = (parents, score.local(post, i, parents))
    got = sc.local_scores(sc.parent_sets(draws, "g", 9), post, score).collect()
    assert len(got) == len(known)
    for x in got:
        parents, value = known[x.chain, x.draw, x.node]
        assert x.parents == parents and abs(x.score - value) < 1e-9
    assert sc.local_scores(sc.parent_sets(draws.limit(0), "g", 9), post, score).collect() == []


def test_toggle_gains_are_differences_of_local_scores(spark, model):
    post, score = model
    sets = [(i, list(p)) for i in (0, 4, 7) for n in range(5) for p in itertools.combinations([1, 2, 3, 5, 8], n)]
    df = spark.createDataFrame(sets, "response int, parents array<int>").repartition(3)
    rows = sc.toggle_gains(df, post, score, range(1, 9)).collect()
    assert len(rows) == sum(8 - (i in range(1, 9)) for i, _ in sets)
    for x in rows:
        other = [p for p in x.parents if p != x.column] if x.column in x.parents else [*x.parents, x.column]
        known = score.local(post, x.response, other) - score.local(post, x.response, x.parents)
        assert abs(x.gain - known) < 1e-9, x
    assert sc.toggle_gains(df.limit(0), post, score, range(9)).collect() == []


def test_nearly_singular_candidates(spark):
    """A copy of a parent adds nothing, but its gain is finite thanks to the prior."""
    x = np.random.default_rng(3).normal(size=(50, 3))
    x = np.column_stack([x, x[:, 1]])
    score = BlockScore.of(12.0, 4, 50)
    post = x.T @ x + score.c0 * np.eye(4)
    df = spark.createDataFrame([(0, [1])], "response int, parents array<int>")
    got = {r.column: r.gain for r in sc.toggle_gains(df, post, score, range(4)).collect()}
    assert set(got) == {1, 2, 3} and abs(got[3] - (score.local(post, 0, [1, 3]) - score.local(post, 0, [1]))) < 1e-9


def test_matrix_has_a_bound(spark):
    cells = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (0, 0, 3.0)], "a int, b int, s double")
    assert sc.matrix_of(cells, 2).tolist() == [[3.0, 2.0], [2.0, 0.0]]
    with pytest.raises(ValueError, match="at most"):
        sc.matrix_of(cells, sc.MAX_WIDTH + 1)


def test_reduced_form_by_substitution():
    r = np.random.default_rng(4)
    now = np.tril(r.normal(size=(40, 6, 6)) * (r.random((40, 6, 6)) < 0.5), -1)
    for k in range(40):
        p = r.permutation(6)
        now[k] = now[k][p][:, p]
    lagged = r.normal(size=(40, 6, 13))
    order, whole = sc.topological(now)
    assert whole.all()
    for k in range(40):
        place = np.argsort(order[k])
        assert sorted(order[k]) == list(range(6)) and all(place[j] < place[i] for i, j in zip(*np.nonzero(now[k])))
    np.testing.assert_allclose(sc.reduced_form(now, lagged), np.linalg.solve(np.eye(6) - now, lagged), atol=1e-9)


def test_reduced_form_with_cycles():
    now = np.zeros((3, 2, 2))
    now[0] = [[0, 0.5], [0.5, 0]]
    now[1] = [[0, 1.0], [1.0, 0]]  # I - now is singular
    lagged = np.arange(12, dtype=float).reshape(3, 2, 2)
    got = sc.reduced_form(now, lagged)
    assert sc.topological(now)[1].tolist() == [False, False, True]
    np.testing.assert_allclose(got[0], np.linalg.solve([[1, -0.5], [-0.5, 1]], lagged[0]))
    assert (got[1] == lagged[1]).all() and (got[2] == lagged[2]).all()


def test_structural_coefficients_of_draws(spark):
    """Against solving every node's normal equations."""
    r = np.random.default_rng(6)
    x = r.normal(size=(90, 5))
    sigma = x.T @ x / 90
    g = (r.random((12, 5, 5)) < 0.5).astype(float)
    g[0], g[1] = 0, 1
    draws = spark.createDataFrame([(0, k, m.ravel().tolist()) for k, m in enumerate(g)], "chain int, draw long, g array<double>")
    known, left = kernels.structural(np.repeat(sigma[None], 12, axis=0), g)
    rows = sc.structural(sc.parent_sets(draws, "g", 5), sigma).collect()
    assert len(rows) == 60
    for row in rows:
        np.testing.assert_allclose(row.coefs, known[row.draw, row.node, row.parents], atol=1e-10)
        assert abs(row.variance - left[row.draw, row.node]) < 1e-10


def test_spectral_radius_equals_the_eigenvalues():
    r = np.random.default_rng(7)
    phi = r.normal(size=(200, 2, 3, 3)) * 0.4
    phi[0] = 0
    phi[1, 1] = phi[1, 0] = np.diag([1.0, 1.0], 1)
    known = []
    for a, b in phi:
        known.append(np.abs(np.linalg.eigvals(np.block([[a, b], [np.eye(3), np.zeros((3, 3))]]))).max())
    np.testing.assert_allclose(kernels.spectral_radius(phi)[2:], known[2:], rtol=2e-6)
    assert (kernels.spectral_radius(phi)[:2] == 0).all()
