"""Named indicators from their public definitions, on a dense panel, as columns by symbol.

Recursive averages (MACD, RSI) and half-life windows (beta, momentum) take time that is linear in a symbol's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantpanel.functions import recurrences as rc
from quantpanel.functions import timeseries as ts


def own_rows():
    return Window.partitionBy("symbol").orderBy("dt")


def turnover(price: Column, volume: Column) -> Column:
    return price * volume


def hull_average(df: DataFrame, x: str, period: int) -> DataFrame:
    """hma: the linear decay over sqrt(period) of twice the half-period decay minus the whole one."""
    parts = rc.linear_decay(rc.linear_decay(df, "_half", F.col(x), max(1, period // 2)), "_whole", F.col(x), period)
    return rc.linear_decay(parts, "hma", 2 * F.col("_half") - F.col("_whole"), max(1, round(period**0.5))).drop("_half", "_whole")


def accumulated_return(x: Column, period: int) -> Column:
    return F.try_divide(x, F.lag(x, period).over(own_rows())) - 1


def slope(x: Column, shift: int = 1) -> Column:
    return x - F.lag(x, shift).over(own_rows())


def previous_difference(x: Column, far: int = 2, near: int = 1) -> Column:
    return F.lag(x, near).over(own_rows()) - F.lag(x, far).over(own_rows())


def previous_rolling_max(x: Column, window: int = 12, default: float = 0.0) -> Column:
    return F.coalesce(F.max(x).over(own_rows().rowsBetween(-window, -1)), F.lit(default))


def rolling_quantile(x: Column, window: int, q: float, scale: float = 1.0) -> Column:
    before = own_rows().rowsBetween(-window, -1)
    return F.when(F.count(x).over(before) == window, F.percentile(x, F.lit(q)).over(before) * scale)


def macd(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, macd_signal, macd_hist with exponential averages that start at the first valid value."""
    valid = F.col(x).isNotNull()
    both = rc.smoothed(df, {"_fast": (F.col(x), 2 / (fast + 1)), "_slow": (F.col(x), 2 / (slow + 1))}, valid)
    line = rc.smoothed(both.withColumn("macd", F.col("_fast") - F.col("_slow")), {"macd_signal": (F.col("macd"), 2 / (signal + 1))}, valid)
    return line.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def rsi(df: DataFrame, x: str = "close", period: int = 14) -> DataFrame:
    """rsi with Wilder's smoothing from the first change on; 100 without losses."""
    valid = F.col(x).isNotNull()
    changed = df.withColumn("_known", valid).withColumn("_d", F.when(valid, F.col(x) - F.lag(x, 1).over(ts.series(("symbol", "_known")))))
    sides = {"_up": (F.greatest("_d", F.lit(0.0)), 1 / period), "_down": (F.greatest(-F.col("_d"), F.lit(0.0)), 1 / period)}
    both = rc.smoothed(changed, sides, F.col("_d").isNotNull())
    return both.withColumn("rsi", 100 * F.try_divide(F.col("_up"), F.col("_up") + F.col("_down"))).drop("_known", "_d", "_up", "_down")


def convergence(df: DataFrame, x: str, window: int) -> DataFrame:
    """Count, largest, smallest, mean and their difference of local peaks and bottoms over the last `window` bars.

    A peak or bottom is confirmed by the bar after it.
    """
    before, middle = F.lag(x, 2).over(own_rows()), F.lag(x, 1).over(own_rows())
    marked = df.withColumns({"_p": F.when((middle > before) & (middle > F.col(x)), middle), "_b": F.when((middle < before) & (middle < F.col(x)), middle)})
    f = ts.frame(window)
    made = {f"{name}_{what}": fn(c).over(f) for name, c in (("peak", "_p"), ("bottom", "_b")) for what, fn in (("count", F.count), ("max", F.max), ("min", F.min), ("mean", F.avg))}
    made |= {f"{name}_diff": F.max(c).over(f) - F.min(c).over(f) for name, c in (("peak", "_p"), ("bottom", "_b"))}
    return marked.withColumns(made).drop("_p", "_b")


def divergence(df: DataFrame, x: str, y: str, window: int) -> DataFrame:
    """new_peak / fake_peak (and bottoms): x reaches a new extreme of the window, y with it or not."""
    before = own_rows().rowsBetween(-window, -1)
    top, bottom = F.col(x) > F.max(x).over(before), F.col(x) < F.min(x).over(before)
    return df.withColumns({"new_peak": top & (F.col(y) > F.max(y).over(before)), "fake_peak": top & ~(F.col(y) > F.max(y).over(before)), "new_bottom": bottom & (F.col(y) < F.min(y).over(before)), "fake_bottom": bottom & ~(F.col(y) < F.min(y).over(before))})


def momentum(df: DataFrame, window: int = 120, lag: int = 5, half_life: float = 60) -> DataFrame:
    """Weighted sum of log returns, lagged, where all of the window's are known."""
    logged = df.withColumn("_r", F.when(F.col("returns") > -1, F.log1p("returns")))
    known = F.count("_r").over(own_rows().rowsBetween(-(window + lag - 1), -lag)) == window
    return rc.halved_sums(logged, {"_sum": F.col("_r")}, window, half_life, lag).withColumn("momentum", F.when(known, F.col("_sum"))).drop("_r", "_sum")


def beta(df: DataFrame, window: int = 252, half_life: float = 63) -> DataFrame:
    """Slope of returns on the market's equal-weighted return, with half-life weights over the window's rows."""
    market = df.withColumn("_m", F.avg("returns").over(Window.partitionBy("dt")))
    r, m = F.col("returns"), F.when(F.col("returns").isNotNull(), F.col("_m"))
    sums = rc.halved_sums(market, {"_x": m, "_y": r, "_xy": r * m, "_xx": m * m}, window, half_life)
    w = F.lit(sum(0.5 ** (k / half_life) for k in range(window)))
    value = F.try_divide(F.col("_xy") - F.col("_x") * F.col("_y") / w, F.col("_xx") - F.col("_x") * F.col("_x") / w)
    return sums.withColumn("beta", ts.full(r, window, value)).drop("_m", "_x", "_y", "_xy", "_xx")


def orthogonal_cube(df: DataFrame, x: str, name: str) -> DataFrame:
    """Residual of x cubed on x across the symbols of each date."""
    d = Window.partitionBy("dt")
    cubed = df.withColumn("_c", F.pow(x, F.lit(3.0)))
    b = F.try_divide(F.covar_samp(F.col(x), F.col("_c")).over(d), F.var_samp(x).over(d))
    return cubed.withColumn(name, F.col("_c") - F.avg("_c").over(d) - b * (F.col(x) - F.avg(x).over(d))).drop("_c")


def size_factor(df: DataFrame) -> DataFrame:
    """size = ln(close * volume), and its orthogonal cube nlsize."""
    return orthogonal_cube(df.withColumn("size", F.ln(F.when(F.col("close") * F.col("volume") > 0, F.col("close") * F.col("volume")))), "size", "nlsize")


def liquidity(df: DataFrame, windows: tuple[int, int, int] = (21, 63, 252), blend: tuple[float, float, float] = (0.35, 0.35, 0.30)) -> DataFrame:
    """Blend of the logs of rolling turnover sums."""
    parts = [F.ln(F.when(ts.ts_sum(F.col("close") * F.col("volume"), w) > 0, ts.ts_sum(F.col("close") * F.col("volume"), w))) * b for w, b in zip(windows, blend, strict=True)]
    return df.withColumn("liquidity", parts[0] + parts[1] + parts[2])


def residual_volatility(df: DataFrame, window: int = 63, blend: tuple[float, float, float] = (0.75, 0.15, 0.10)) -> DataFrame:
    """Blend of the deviation of returns, the range of cumulated log returns and the deviation of market-adjusted returns."""
    adjusted = df.withColumns({"_a": F.col("returns") - F.avg("returns").over(Window.partitionBy("dt")), "_l": F.sum(F.when(F.col("returns") > -1, F.log1p("returns"))).over(own_rows().rowsBetween(Window.unboundedPreceding, 0))})
    return adjusted.withColumn("resid_vol", ts.ts_std(F.col("returns"), window) * blend[0] + (ts.ts_max(F.col("_l"), window) - ts.ts_min(F.col("_l"), window)) * blend[1] + ts.ts_std(F.col("_a"), window) * blend[2]).drop("_a", "_l")
