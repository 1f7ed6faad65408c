"""Design rows, cross products, prior variances and block scores against closed forms."""

import numpy as np
from pyspark.sql import functions as F

from voltweave.operators import bayes

DIMS = bayes.Dims(ny=3, nz=2, lags=(1, 3))


def simulate(t_full=160, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(t_full, 2))
    y = np.zeros((t_full, 3))
    for t in range(1, t_full):
        e = rng.normal(size=3) * 0.5
        y[t, 0] = 0.6 * y[t - 1, 0] + e[0]
        y[t, 1] = 0.7 * x[t - 1, 1] + e[1]
        y[t, 2] = -0.6 * y[t - 1, 0] + e[2]
    return (y - y.mean(0)) / y.std(0), x


def frames(spark, y, x):
    import datetime

    day = lambda t: datetime.date(2025, 1, 1) + datetime.timedelta(days=int(t))
    make = lambda m: spark.createDataFrame(
        [(day(t), k, float(m[t, k])) for t in range(len(m)) for k in range(m.shape[1])],
        "date date, idx int, value double")
    return bayes.day_vectors(make(y)), bayes.day_vectors(make(x))


def numpy_design(y, x, lags):
    m = max(lags)
    parts = [y[m:]]
    for k in lags:
        parts += [y[m - k : len(y) - k], x[m - k : len(x) - k]]
    return np.hstack(parts)


def test_design_and_gram(spark):
    y, x = simulate(40)
    design = bayes.design_rows(*frames(spark, y, x), DIMS)
    want = numpy_design(y, x, DIMS.lags)
    got = np.array([r.d for r in design.orderBy("t").collect()])
    assert np.allclose(got, want)
    g = bayes.gram(design.withColumn("k", F.lit("a")), ["k"]).first().gram
    assert np.allclose(np.reshape(g, (DIMS.width, -1)), want.T @ want)
    weighted = design.withColumn("k", F.lit("a")).withColumn("w", F.col("t") + 1.0)
    g = bayes.gram(weighted, ["k"], "d", "w").first().gram
    assert np.allclose(np.reshape(g, (DIMS.width, -1)), (want.T * (np.arange(len(want)) + 1)) @ want)


def test_minnesota_variances_follow_value_and_ordinal():
    om = bayes.minnesota_variances(bayes.Dims(2, 1, (1, 7)), 0.001, 2.0, 0.5)
    assert np.allclose(om, [0.001, 0.001, 0.0005, 0.001 / 49, 0.001 / 49, 0.0005 / 4])


def test_block_score_is_the_wishart_marginal():
    """Adding a response is a ratio of block marginals; compare with the direct one-variable formula."""
    from math import lgamma

    rng = np.random.default_rng(0)
    data = rng.normal(size=(30, 2))
    sc = bayes.BlockScore(alpha=7.0, c0=2.0, t_obs=30)
    post = data.T @ data + 2.0 * np.eye(2)
    one = -15 * np.log(np.pi) + lgamma(18.5) - lgamma(3.5) + 3.5 * np.log(2.0) - 18.5 * np.log(post[0, 0])
    assert np.isclose(sc.log_marginal(post, [0]), one)
    assert np.isclose(sc.local(post, 0, [1]), sc.log_marginal(post, [0, 1]) - sc.log_marginal(post, [1]))
    assert sc.local(post, 0, []) == sc.log_marginal(post, [0])


def test_scale_constant_falls_back_to_one():
    assert bayes.BlockScore.temporal(bayes.Dims(28, 53, (1, 7)), 358).c0 == 1.0
