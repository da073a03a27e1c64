"""Indicators against pandas on random series, including series long enough to need several fold blocks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barwright.operators import folds, risk, windows as win


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    n = 3000
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    pdf = pd.DataFrame({"symbol": "A", "ts": [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(n)], "close": close})
    pdf["high"], pdf["low"] = close * (1 + rng.random(n) / 100), close * (1 - rng.random(n) / 100)
    pdf["open"], pdf["volume"] = close, rng.integers(1, 100, n)
    return pdf


def got(df, col):
    return np.array([np.nan if r[col] is None else r[col] for r in df.orderBy("ts").select(col).collect()], dtype=float)


@pytest.mark.parametrize("n", [3, 8, 55, 200])
def test_ema(spark, series, n):
    b = folds.ema(spark.createDataFrame(series), "close", n, "e")
    np.testing.assert_allclose(got(b, "e"), series.close.ewm(span=n, adjust=False).mean(), rtol=1e-11)


def test_emas_of_distant_lengths(spark, series):
    b = folds.emas(spark.createDataFrame(series), "close", {"a": 2, "b": 900})
    np.testing.assert_allclose(got(b, "a"), series.close.ewm(span=2, adjust=False).mean(), rtol=1e-11)
    np.testing.assert_allclose(got(b, "b"), series.close.ewm(span=900, adjust=False).mean(), rtol=1e-11)


def test_emas_of_one_row_and_of_rates_far_apart_in_one_pass(spark, series):
    """n = 1 is the series itself; slow and fast rates share one path."""
    b = folds.emas(spark.createDataFrame(series), "close", {"a": 1, "b": 2, "c": 5000})
    for c, n in (("a", 1), ("b", 2), ("c", 5000)):
        np.testing.assert_allclose(got(b, c), series.close.ewm(span=n, adjust=False).mean(), rtol=1e-11)


@pytest.mark.parametrize("a", [0.0, 1e-3, 0.5, 0.98, 0.9999, 1.0])
def test_decayed_sums_keep_all_history(spark, a):
    """Against the recursion over 100,000 rows whose old values outweigh the new ones by far."""
    n = 100_000
    x = np.random.default_rng(8).normal(0, 1, n)
    x[10], x[40_000] = 1e200, -1e150
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": np.arange(n), "x": x}))
    out, y = np.empty(n), 0.0
    for i, v in enumerate(x):
        y = a * y + v
        out[i] = y
    np.testing.assert_allclose(got(folds.decayed_sums(df, {"y": ("x", a)}), "y"), out, rtol=1e-9, atol=1e-9)


def test_linear_scan(spark):
    """Weights that vary by row, with zeros that start anew and falls beyond the range of a double."""
    rng = np.random.default_rng(9)
    keep = rng.choice([0.0, 1.0, 0.5, 1e-9], 20_000, p=[0.01, 0.5, 0.4, 0.09])
    add = rng.normal(0, 1, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 3, 20_000), "ts": np.arange(20_000), "keep": keep, "add": add}))
    y, p = {}, {}
    want = []
    for r in df.orderBy("ts").toPandas().itertuples():
        y[r.k], p[r.k] = r.keep * y.get(r.k, 0.0) + r.add, r.keep * p.get(r.k, 1.0)
        want.append((y[r.k], p[r.k]))
    res = folds.linear_scan(df, "keep", "add", "y", ("k",), ("ts",), "p")
    np.testing.assert_allclose(got(res, "y"), [w[0] for w in want], rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got(res, "p"), [w[1] for w in want], rtol=1e-9, atol=1e-300)


def test_adx(spark, series):
    p = series
    tr = pd.concat([p.high - p.low, (p.high - p.close.shift()).abs(), (p.low - p.close.shift()).abs()], axis=1).max(axis=1)
    up, down = p.high.diff(), -p.low.diff()
    plus = pd.Series(np.where((up > down) & (up > 0), up, 0)).ewm(span=14).mean()
    minus = pd.Series(np.where((down > up) & (down > 0), down, 0)).ewm(span=14).mean()
    t = tr.ewm(span=14).mean()
    pdi, mdi = 100 * plus / t, 100 * minus / t
    want = (100 * (pdi - mdi).abs() / (pdi + mdi)).ewm(span=14).mean()
    np.testing.assert_allclose(got(folds.adx(spark.createDataFrame(p)), "adx"), want, rtol=1e-9)


def test_rsi_and_moments(spark, series):
    b = win.rolling_moments(win.rsi(spark.createDataFrame(series), 14))
    d = series.close.diff()
    g, l = d.clip(lower=0).fillna(0).rolling(14).mean(), (-d.clip(upper=0)).fillna(0).rolling(14).mean()
    np.testing.assert_allclose(got(b, "rsi_14"), 100 - 100 / (1 + g / l), rtol=1e-9)
    ret = series.close.pct_change()
    np.testing.assert_allclose(got(b, "skew"), ret.rolling(63).skew(), rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(got(b, "kurt"), ret.rolling(63).kurt(), rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("block", [256, 3])
def test_correlation_matrix_is_block_size_independent(spark, block):
    rng = np.random.default_rng(5)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x)) for s in "ABCDEFG" for i, x in enumerate(100 * np.exp(np.cumsum(rng.normal(0, .02, 90)))) if not (s == "C" and i == 40)]
    df = spark.createDataFrame(rows, "symbol string, ts date, close double")
    pdf = pd.DataFrame(rows, columns=["s", "t", "c"])
    rets = pd.DataFrame({s: g.set_index("t").c.pct_change() for s, g in pdf.groupby("s")}).dropna(how="any")
    want = rets.corr()
    out = risk.correlation_matrix(df, block).collect()
    assert len(out) == 42
    for r in out:
        assert r["corr"] == pytest.approx(want.loc[r.a, r.b], abs=1e-10)


@pytest.mark.parametrize("size", [256, 2])
def test_correlation_partners(spark, size):
    """Means, maxima and first three by brute force: many active, one active (it meets all others), none; a constant series."""
    rng = np.random.default_rng(6)
    walk = {s: 100 * np.exp(np.cumsum(rng.normal(0, .02, 60))) for s in "ABCDEFG"} | {"K": np.full(60, 7.0)}
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x)) for s, p in walk.items() for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "symbol string, ts date, close double")
    corr = pd.DataFrame(walk).pct_change().iloc[1:].corr()
    for active in (["A", "C", "K", "none"], ["B"], []):
        got = {r.symbol: r for r in risk.correlation_partners(df, spark.createDataFrame([(s,) for s in active], "symbol string"), size=size).collect()}
        assert set(got) == set(walk)
        for s in walk:
            partners = [b for b in active if b != s and b in walk] or [b for b in walk if b != s]
            c = sorted(((np.isnan(corr.loc[s, b]), -np.nan_to_num(corr.loc[s, b]), b) for b in partners))
            known = [-d for nan, d, _ in c if not nan]
            assert got[s].top_correlated == ",".join(b for _, _, b in c[:3])
            assert got[s].avg_correlation == (pytest.approx(np.mean(known)) if known else None) and got[s].max_correlation == (pytest.approx(max(known)) if known else None)
