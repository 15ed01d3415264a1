"""Every operator against pandas on a small panel with holes and a constant stretch, and on a prefix of it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantpanel.functions import cross, elementwise, timeseries

SYMBOLS, DAYS, D = list("ABCDE"), 60, 5


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(0)
    index = pd.bdate_range("2020-01-01", periods=DAYS)
    x = pd.DataFrame(rng.normal(size=(DAYS, len(SYMBOLS))).round(3), index, SYMBOLS)
    y = pd.DataFrame(rng.normal(size=(DAYS, len(SYMBOLS))).round(3), index, SYMBOLS)
    x.iloc[7, 0] = x.iloc[20, 2] = y.iloc[30, 1] = np.nan
    x.iloc[40:50, 3] = 1.5
    x.iloc[5, 1] = x.iloc[5, 4]
    x.iloc[11] = 0.0
    return x, y


@pytest.fixture(scope="module")
def panel(spark, frames):
    return as_table(spark, *frames)


def as_table(spark, x, y):
    long = pd.concat([x.stack(future_stack=True), y.stack(future_stack=True)], axis=1, keys=["x", "y"]).reset_index(names=["dt", "symbol"])
    rows = [(d.date(), s, None if np.isnan(a) else float(a), None if np.isnan(b) else float(b)) for d, s, a, b in long.itertuples(index=False)]
    return spark.createDataFrame(rows, "dt date, symbol string, x double, y double").cache()


def wide(df, column):
    got = df.select("dt", "symbol", column.alias("v")).toPandas()
    out = got.pivot(index="dt", columns="symbol", values="v").astype(float)
    out.index = pd.to_datetime(out.index)
    return out


def rolling(f):
    return lambda x, y: f(x.rolling(D, min_periods=D))


def masked(f):
    def run(x, y):
        ready = x.rolling(D).count().eq(D) & y.rolling(D).count().eq(D)
        return f(x, y).where(ready)

    return run


def pandas_corr(x, y):
    sx, sy = x.rolling(D).std(), y.rolling(D).std()
    return (x.rolling(D).cov(y) / (sx * sy)).where((sx > 1e-9) & (sy > 1e-9))


def cases():
    X, Y = F.col("x"), F.col("y")
    E, C, T = elementwise, cross, timeseries
    weights = np.arange(1, D + 1) / (D * (D + 1) / 2)
    return {
        "neg": (E.neg(X), lambda x, y: -x),
        "sub": (E.sub(X, Y), lambda x, y: x - y),
        "mul": (E.mul(X, 2), lambda x, y: x * 2),
        "div": (E.div(Y, X), lambda x, y: y / x.replace(0, np.nan)),
        "abs": (E.absolute(X), lambda x, y: x.abs()),
        "sign": (E.sign(X), lambda x, y: np.sign(x)),
        "signed_log1p": (E.signed_log1p(X), lambda x, y: np.sign(x) * np.log1p(x.abs())),
        "pow": (E.power(X, 0.5), lambda x, y: x.where(x >= 0) ** 0.5),
        "pow_negative": (E.power(X, -1), lambda x, y: x.where(x != 0) ** -1.0),
        "signed_pow": (E.signed_power(X, 2), lambda x, y: np.sign(x) * x.abs() ** 2),
        "min": (E.at_most(X, 0.3), lambda x, y: np.minimum(x, 0.3)),
        "max": (E.at_least(X, 0.3), lambda x, y: np.maximum(x, 0.3)),
        "rank": (C.rank(X), lambda x, y: x.rank(axis=1, pct=True)),
        "zscore": (C.zscore(X), lambda x, y: x.sub(x.mean(axis=1), axis=0).div(x.std(axis=1).replace(0, np.nan), axis=0)),
        "demean": (C.demean(X), lambda x, y: x.sub(x.mean(axis=1), axis=0)),
        "scale": (C.scale(X, 2), lambda x, y: x.div(x.abs().sum(axis=1).replace(0, np.nan), axis=0) * 2),
        "delay": (T.delay(X, 3), lambda x, y: x.shift(3)),
        "delta": (T.delta(X, 3), lambda x, y: x - x.shift(3)),
        "ts_mean": (T.ts_mean(X, D), rolling(lambda r: r.mean())),
        "ts_std": (T.ts_std(X, D), rolling(lambda r: r.std())),
        "ts_sum": (T.ts_sum(X, D), rolling(lambda r: r.sum())),
        "ts_min": (T.ts_min(X, D), rolling(lambda r: r.min())),
        "ts_max": (T.ts_max(X, D), rolling(lambda r: r.max())),
        "ts_rank": (T.ts_rank(X, D), rolling(lambda r: r.apply(lambda w: (w <= w[-1]).mean(), raw=True))),
        "ts_corr": (T.ts_corr(X, Y, D), masked(pandas_corr)),
        "ts_cov": (T.ts_cov(X, Y, D), masked(lambda x, y: x.rolling(D).cov(y))),
        "decay_linear": (T.decay_linear(X, D), rolling(lambda r: r.apply(lambda w: w @ weights, raw=True))),
        "product": (T.product(X, D), rolling(lambda r: r.apply(np.prod, raw=True))),
    }


NAMES = ["neg", "sub", "mul", "div", "abs", "sign", "signed_log1p", "pow", "pow_negative", "signed_pow", "min", "max", "rank", "zscore", "demean", "scale", "delay", "delta", "ts_mean", "ts_std", "ts_sum", "ts_min", "ts_max", "ts_rank", "ts_corr", "ts_cov", "decay_linear", "product"]


@pytest.fixture(scope="module")
def results(spark, panel):
    """All operators over the whole panel in one plan."""
    df = panel.select("dt", "symbol", *(c.alias(n) for n, (c, _) in cases().items())).toPandas()
    return {n: df.pivot(index="dt", columns="symbol", values=n).astype(float) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_equals_pandas(name, results, frames):
    expected = cases()[name][1](*frames)
    got = results[name].to_numpy()
    assert (np.isnan(got) == np.isnan(expected.to_numpy())).all()
    np.testing.assert_allclose(got, expected.to_numpy(), atol=1e-9)


def test_prefix_of_the_result_is_the_result_on_the_prefix(spark, frames, results):
    x, y = frames
    part = as_table(spark, x.iloc[:40], y.iloc[:40])
    df = part.select("dt", "symbol", *(c.alias(n) for n, (c, _) in cases().items())).toPandas()
    for n in NAMES:
        got = df.pivot(index="dt", columns="symbol", values=n).astype(float).to_numpy()
        np.testing.assert_allclose(got, results[n].to_numpy()[:40], atol=1e-12, err_msg=n)


def test_a_window_below_one_is_refused(spark):
    with pytest.raises(ValueError):
        timeseries.delay(F.col("x"), -1)


def test_long_decay_equals_short_form(spark, panel, frames):
    d = timeseries.LAGS + 3
    w = np.arange(1, d + 1) / (d * (d + 1) / 2)
    expected = frames[0].rolling(d, min_periods=d).apply(lambda v: v @ w, raw=True).to_numpy()
    np.testing.assert_allclose(wide(panel, timeseries.decay_linear(F.col("x"), d)).to_numpy(), expected, atol=1e-9)
