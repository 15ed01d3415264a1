"""Recurrences and weighted windows against plain loops, on long series, gaps and values that aren't finite."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantpanel.functions import recurrences as R
from quantpanel.operators import indicators as I


@pytest.fixture(scope="module")
def bars(spark):
    """100,000 bars of one symbol and a few of two others, with gaps and a long flat stretch."""
    long = spark.range(100_000).select(F.lit("A").alias("symbol"), F.expr("date_add(date'1700-01-01', int(id))").alias("dt"), "id")
    short = spark.range(70).select(F.lit("B").alias("symbol"), F.expr("date_add(date'1700-01-01', int(id))").alias("dt"), "id").union(spark.range(1).select(F.lit("C"), F.expr("date'1700-01-01'"), "id"))
    close = F.when((F.col("id") > 40_000) & (F.col("id") < 42_000), 100.0).otherwise(100 + F.sin(F.col("id") * 0.7) * 10 + F.col("id") % 13)
    return long.union(short).select("symbol", "dt", F.when(F.col("id") % 97 != 5, close).alias("close"), (F.sin(F.col("id") * 1.3) / 50).alias("returns"), "id").cache()


def series(df, *columns):
    out = {}
    for r in df.orderBy("symbol", "dt").select("symbol", *columns).collect():
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return out


def same(a, b, places=9):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=10**-places, abs_tol=10**-places))


def test_averages_of_a_long_series_equal_a_loop(spark, bars):
    began = time.time()
    got = series(I.rsi(I.macd(bars)), "close", "macd", "macd_signal", "macd_hist", "rsi")
    assert time.time() - began < 60
    for rows in got.values():
        fast = slow = signal = last = up = down = None
        for close, macd, macd_signal, hist, rsi in rows:
            if close is None:
                assert macd is macd_signal is hist is rsi is None
                continue
            step = lambda y, x, a: x if y is None else y * (1 - a) + x * a
            fast, slow = step(fast, close, 2 / 13), step(slow, close, 2 / 27)
            signal = step(signal, fast - slow, 2 / 10)
            assert same(macd, fast - slow) and same(macd_signal, signal) and same(hist, fast - slow - signal)
            if last is not None:
                up, down = step(up, max(close - last, 0), 1 / 14), step(down, max(last - close, 0), 1 / 14)
            assert same(rsi, None if up is None or up + down == 0 else 100 * up / (up + down))
            last = close


@pytest.mark.parametrize("chunk", [1, 2, 3, 32])
def test_recurrences_with_changing_coefficients(spark, chunk):
    rng = np.random.default_rng(chunk)
    data = [(s, i, float(c), None if rng.random() < 0.2 else float(o)) for s in "xy" for i, (c, o) in enumerate(rng.normal(0, 1, (60, 2)))]
    df = spark.createDataFrame(data, "symbol string, dt int, c double, o double")
    got = series(R.recurrences(df, {"y": (F.col("c"), F.col("o")), "z": (F.lit(1.0), F.col("o"))}, F.col("o").isNotNull(), chunk=chunk), "c", "o", "y", "z")
    for rows in got.values():
        y = z = 0.0
        for c, o, found, total in rows:
            if o is not None:
                y, z = y * c + o, z + o
            assert same(found, None if o is None else y) and same(total, None if o is None else z)


def test_windows_equal_their_definition(spark, bars):
    few = bars.where("id < 900")
    made = R.linear_decay(R.halved_sums(few, {"h": F.col("close"), "r": F.col("returns")}, 50, 7.0, lag=3), "d", F.col("returns"), 40)
    for rows in series(made, "close", "returns", "h", "r", "d").values():
        for i, row in enumerate(rows):
            weighted = lambda k: sum(0.5 ** (j / 7) * (rows[i - 3 - j][k] or 0) for j in range(50))
            assert same(row[2], weighted(0) if i >= 52 else None) and same(row[3], weighted(1) if i >= 52 else None)
            assert same(row[4], sum((40 - j) * rows[i - j][1] for j in range(40)) / 820 if i >= 39 else None)


def test_a_value_that_is_not_finite_stays_in_its_windows(spark):
    df = spark.createDataFrame([("a", i, float("inf") if i == 20 else 1.0) for i in range(60)], "symbol string, dt int, x double")
    rows = series(R.halved_sums(df, {"h": F.col("x")}, 8, 3.0), "h")["a"]
    assert [i for i, (h,) in enumerate(rows) if h is not None and not math.isfinite(h)] == list(range(20, 28))
    with pytest.raises(ValueError):
        R.halved_sums(df, {"h": F.col("x")}, 5000, 1.0)


def test_long_histories_are_never_one_row(spark, bars):
    plan = I.rsi(I.macd(bars))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "Generate" not in plan and "Aggregate [symbol" not in plan
