import numpy as np
import pytest
from pyspark.sql import functions as F

from voltweave.operators.quantiles import exact_quantiles
from voltweave.operators.series import (
    autocovariance_sums, lag_products, monotone_tau, running_means,
)


def _rows(df, *order):
    return df.orderBy(*order).toPandas()


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    data = {
        "heavy": np.concatenate([rng.normal(size=300), [1e9, -1e9]]),
        "ties": rng.integers(0, 3, 250).astype(float),
        "tiny": np.array([4.0, 1.0]),
        "const": np.full(90, 2.5),
        "full": np.concatenate([np.full(900, 7.0), rng.normal(size=100)]),
        None: np.array([1.0, 3.0]),
    }
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("heavy", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = exact_quantiles(df, ["k"], "v", {"lo": 0.05, "med": 0.5, "hi": 0.95}, "mean")
    got = {r.k: r for r in got.collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        want = np.quantile(vs, [0.05, 0.5, 0.95])
        assert np.allclose([got[k].lo, got[k].med, got[k].hi], want, rtol=1e-12, atol=0), k
        assert np.isclose(got[k]["mean"], vs.mean(), atol=1e-9), k


def test_exact_quantiles_with_infinities_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("p", v) for v in [inf, *map(float, range(499))]] + [("n", v) for v in [-inf, -inf, 1.0]] + [
        ("x", v) for v in [nan, 1.0, 2.0]] + [("i", inf), ("i", inf)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.q for r in exact_quantiles(df, ["k"], "v", {"q": 0.5}).collect()}
    assert got == {"p": 249.5, "n": -inf, "x": 2.0, "i": inf}


def test_exact_quantiles_without_keys(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    row = exact_quantiles(df, [], "v", {"q": 0.9}).collect()
    assert [r.q for r in row] == [90.0]
    assert exact_quantiles(df.where("v < 0"), [], "v", {"q": 0.9}).collect() == []


@pytest.mark.parametrize("small", [1, 7, 200_000])
def test_large_intervals_are_counted_again(spark, monkeypatch, small):
    from voltweave.operators import quantiles

    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "PARTS", 3)
    rng = np.random.default_rng(8)
    data = {
        "narrow": 1000 + rng.random(400), "same": np.full(300, 1e-300), "signs": np.concatenate([-rng.random(90), np.zeros(50), rng.random(60)]),
        "wide": np.exp(rng.uniform(-700, 700, 200)) * rng.choice([-1, 1], 200), "two": np.r_[np.full(99, 3.0), np.full(99, np.nextafter(3.0, 4.0))], None: -rng.random(80) * 1e-310,
    }
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("none", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"lo": 0.05, "med": 0.5, "hi": 0.95}, "mean", empty=True).collect()}
    assert set(got) == {*data, "none"} and got["none"].asDict() == {"k": "none", "mean": None, "lo": None, "med": None, "hi": None}
    for k, vs in data.items():
        assert np.allclose([got[k].lo, got[k].med, got[k].hi], np.quantile(vs, [0.05, 0.5, 0.95]), rtol=1e-12, atol=0), k
    assert exact_quantiles(df.limit(0), ["k"], "v", {"q": 0.5}, empty=True).collect() == []


@pytest.mark.parametrize("block,lo,hi", [(4, 0, 4), (4, 3, 7), (16, 0, 9), (4, 9, 12), (64, 0, 40), (4, 0, 37), (5, 2, 31)])
def test_lag_products_across_blocks(spark, block, lo, hi):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(37, 3))
    df = spark.createDataFrame(
        [("s", t, [float(v) for v in x[t]]) for t in range(37)], "k string, pos long, x array<double>"
    )
    got = lag_products(df, ["k"], "pos", "x", lo, hi, block).collect()
    want = {(c, k): x[: 37 - k, c] @ x[k:, c] for k in range(lo, min(hi, 37)) for c in range(3)}
    assert {(r.cell, r.lag) for r in got} == set(want)
    for r in got:
        assert np.isclose(r.s, want[r.cell, r.lag])


def test_running_means_across_blocks(spark):
    x = np.random.default_rng(1).normal(size=50)
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "k string, t int, v double")
    got = running_means(df, ["k"], "t", "v", block=7).orderBy("t").toPandas()
    assert np.allclose(got["running_mean"], np.cumsum(x) / np.arange(1, 51))


def _tau(x):
    n = len(x)
    xc = x - x.mean()
    rho = np.array([xc[: n - k] @ xc[k:] for k in range(n)]) / (xc @ xc)
    total, last = 0.0, np.inf
    for m in range((n - 2) // 2):
        p = rho[2 * m + 1] + rho[2 * m + 2]
        if p <= 0:
            break
        last = min(last, p)
        total += last
    return max(1 + 2 * total, 1.0)


@pytest.mark.parametrize("chunk", [2, 8, 256])
def test_monotone_tau_extends_until_truncated(spark, chunk):
    rng = np.random.default_rng(8)
    slow = np.cumsum(rng.normal(size=60))
    fast = rng.normal(size=60)
    df = spark.createDataFrame(
        [(t, [float(slow[t]), float(fast[t])]) for t in range(60)], "pos long, x array<double>"
    ).withColumn("k", F.lit("s"))
    zero = autocovariance_sums(df, ["k"], "pos", "x", 0).select("k", "cell", "n", F.col("s").alias("s0"))

    def rho_at(lo, hi):
        from voltweave.operators.series import centred
        part = lag_products(centred(df, ["k"], "x"), ["k"], "pos", "x", lo, hi, 16)
        return part.join(zero, ["k", "cell"]).select("k", "cell", "n", "lag", (F.col("s") / F.col("s0")).alias("rho"))

    got = {r.cell: r.tau for r in monotone_tau(rho_at, ["k", "cell"], 60, chunk).collect()}
    assert np.isclose(got[0], _tau(slow)) and np.isclose(got[1], _tau(fast))
