"""Gap repair and panel rules on hand-made series."""

import datetime

import numpy as np
import pandas as pd
import pytest

from voltweave.operators import impute, panel
from voltweave.plans.assemble import assemble

START = datetime.date(2025, 1, 1)


def day(k):
    return START + datetime.timedelta(days=int(k))


def series(spark, **named):
    rows = [(n, day(t), None if v is None or np.isnan(v) else float(v)) for n, vs in named.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series string, date date, value double")


def back(df, name):
    pdf = df.where(f"series = '{name}'").orderBy("date").toPandas()
    return pdf["value"].to_numpy(float)


def punched(n, gaps, f):
    x = np.array([f(t) for t in range(n)], float)
    for a, length in gaps:
        x[a : a + length] = np.nan
    return x


def test_forward_fill_limit(spark):
    df = series(spark, a=[1, None, None, None, 5, None])
    assert np.array_equal(back(impute.forward_fill(df, ["series"]), "a"), [1, 1, 1, np.nan, 5, 5], equal_nan=True)


def test_gap_lengths(spark):
    df = series(spark, a=[None, 1, None, None, 2, None, None, None], b=[1, 2, 3, 4, 5, 6, 7, 8])
    got = impute.gap_lengths(df, ["series"]).orderBy("series", "date").toPandas()
    assert got[got.series == "a"].gap.tolist() == [1, 0, 2, 2, 0, 3, 3, 3]
    assert got[got.series == "b"].gap.tolist() == [0] * 8


def test_spline_restores_cubics_in_short_gaps_only(spark):
    f = lambda t: 0.01 * t**3 - 0.2 * t**2 + t
    x = punched(50, [(0, 2), (5, 5), (20, 7), (35, 8), (48, 2)], f)
    few = punched(50, [(1, 5), (8, 42)], f)
    few[0], few[6], few[7] = 1.0, 2.0, 3.0
    got = impute.spline_fill(series(spark, a=x, few=few), ["series"])
    want = np.array([f(t) for t in range(50)], float)
    a = back(got, "a")
    assert np.allclose(a[5:10], want[5:10]) and np.allclose(a[20:27], want[20:27])
    assert np.isnan(a[35:43]).all() and np.isnan(a[:2]).all() and np.isnan(a[48:]).all()
    assert np.array_equal(back(got, "few"), few, equal_nan=True)


def seasonal_by_pandas(x, limit=16):
    """The same rule written with pandas."""
    s = pd.Series(x, index=pd.date_range(START, periods=len(x)))
    null = s.isna()
    size = null.astype(int).groupby((null != null.shift()).cumsum()).transform("sum")
    season = s.groupby(s.index.dayofweek).transform("median")
    rest = (s - season).interpolate(method="time", limit=limit, limit_direction="forward")
    out = s.copy()
    use = null & (size <= limit)
    out[use] = (rest + season)[use]
    return out.to_numpy()


@pytest.mark.parametrize("seed", range(4))
def test_seasonal_fill_matches_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    f = lambda t: 10 + 3 * (t % 7) + rng.normal()
    xs = {
        "a": punched(90, [(0, 3), (10, 16), (40, 17), (70, 4), (85, 5)], f),
        "b": punched(40, [(5, 1), (39, 1)], f),
        "c": punched(30, [(8, 14), (25, 5)], f),
    }
    got = impute.seasonal_fill(series(spark, **xs), ["series"])
    for name, x in xs.items():
        assert np.allclose(back(got, name), seasonal_by_pandas(x), equal_nan=True), name


def test_cascade_reclassifies_after_forward_fill(spark):
    f = lambda t: 0.5 * t
    x = punched(120, [(10, 2), (20, 9), (40, 10), (60, 18), (90, 19)], f)
    got = impute.impute(series(spark, a=x), ["series"])
    a = back(got, "a")
    assert a[10] == a[11] == x[9]
    # Nine missing days leave seven after the fill: spline, still. Ten leave eight: seasonal.
    assert not np.isnan(a[20:29]).any() and not np.isnan(a[40:50]).any() and not np.isnan(a[60:78]).any()
    assert a[90] == a[91] == x[89] and np.isnan(a[92:109]).all()
    report = impute.gap_report(got, ["series"]).collect()
    assert [(r.total_null, r.n_blocks, r.max_block_len, len(r.dates)) for r in report] == [(17, 1, 17, 17)]


@pytest.mark.parametrize("seed", range(4))
def test_one_pass_equals_the_three_fills(spark, seed):
    r = np.random.default_rng(seed)
    named = {}
    for k in range(12):
        n = 70 if k else 3
        x = np.cumsum(r.normal(size=n))
        for _ in range(int(r.integers(0, 7))):
            a = int(r.integers(0, n))
            x[a: a + int(r.choice([1, 2, 3, 7, 9, 10, 17, 19, 30]))] = np.nan
        named[f"s{k}"] = x
    named |= {"none": np.full(20, np.nan), "one": np.r_[1.0, np.full(25, np.nan)], "late": np.r_[np.full(12, np.nan), 1.0, 2.0]}
    df = series(spark, **named).repartition(3)
    cascade = impute.seasonal_fill(impute.spline_fill(impute.forward_fill(df, ["series"]), ["series"]), ["series"])
    got = impute.impute(df, ["series"])
    assert got.columns == df.columns and got.count() == df.count()
    for name in named:
        np.testing.assert_allclose(back(got, name), back(cascade, name), atol=1e-9, err_msg=name)
    assert impute.impute(df.limit(0), ["series"]).collect() == []


def test_countries_calendar_and_standardise(spark):
    c = spark.createDataFrame([(0, "AT"), (1, "BE"), (2, "CH")], "idx int, country string")
    price = spark.createDataFrame([("AT",), ("BE",)], "country string")
    load = spark.createDataFrame([("AT",)], "country string")
    assert [r.country for r in panel.included_countries(c, price, load).collect()] == ["AT"]
    out = {r.country: r.missing for r in panel.excluded_countries(c, price, load).collect()}
    assert out == {"BE": "Load", "CH": "Price, Load"}
    df = series(spark, flat=[2, 2, 2], ramp=[1, 2, 3])
    with pytest.raises(ValueError, match="flat"):
        panel.standardise(df, ["series"], strict=True)
    z = panel.standardise(df, ["series"], strict=False)
    assert back(z.drop("value").withColumnRenamed("z", "value"), "flat").tolist() == [0, 0, 0]
    assert back(z.drop("value").withColumnRenamed("z", "value"), "ramp").tolist() == [-1, 0, 1]


def test_column_selection_rules():
    cols = ["AT_Wind", "AT_Solar", "BE_Wind"]
    assert panel.exogenous_columns(cols, ["wind", "solar"]) == ["AT_Wind", "BE_Wind", "AT_Solar"]
    with pytest.raises(ValueError):
        panel.exogenous_columns(cols, ["hydro"])
    assert panel.wanted_columns(cols, ["BE", "CH", "AT"], "Wind") == (["BE_Wind", "AT_Wind"], ["CH_Wind"])


def test_assembled_panel(spark):
    rng = np.random.default_rng(0)

    def feed(variable, countries, days, skip=()):
        rows = [(day(t), c, variable, float(rng.normal())) for c in countries for t in days if (c, t) not in skip]
        return spark.createDataFrame(rows, "date date, country string, variable string, value double")

    gen = feed("Wind", ["AT", "IE"], range(40), {("AT", 5)}).unionByName(feed("Solar", ["AT", "IE"], range(40)))
    price = feed("Price", ["AT", "IE", "MD"], range(2, 40), {("AT", 8)})
    load, rm = feed("Load", ["AT", "IE"], range(38)), feed("RM", ["AT", "IE"], range(40))
    c = spark.createDataFrame([(0, "AT"), (1, "IE"), (2, "MD")], "idx int, country string")
    done = assemble(gen, load, price, rm, c)
    assert [r.country for r in done.countries.orderBy("idx").collect()] == ["AT", "IE"]
    y = done.endogenous.toPandas()
    assert sorted(set(y.country + "_" + y.variable)) == ["AT_Load", "AT_Price", "IE_Load", "IE_Price"]
    assert (y.groupby(["country", "variable"]).size() == 36).all() and y.value.notna().all()
    filled = y[(y.country == "AT") & (y.variable == "Price")].sort_values("date").value.to_numpy()
    assert filled[6] == filled[5]
    x = done.exogenous.toPandas()
    assert "IE_Solar" not in set(x.country + "_" + x.variable)
    assert x[(x.country == "AT") & (x.variable == "Wind") & (x.date == day(5))].value.tolist() == [0.0]
