"""Metrics of daily returns by group (a candidate, a candidate and phase).

Formulas where none is published: excess return r - rf / periods; sharpe and ann_vol with the sample deviation; sortino
with the root mean square of negative excess returns over all bars; geometric cagr; drawdown from a path that starts at 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantpanel.schema import ACTIVE, OBJECTIVES, Config

INF = float("inf")
#: A deviation below this is zero: sums of floating-point numbers rarely cancel exactly.
ZERO = 1e-12
NAMES = ("sortino", "sharpe", "calmar", "cagr", "ann_return", "maxdd", "ann_vol", "hit_rate", "avg_turnover", "avg_gross", "n", "n_active")


def nav(daily: DataFrame, by: Sequence[str], cash: float = 1.0) -> DataFrame:
    """`daily` with nav, the compounded value, and ruined where a return of -1 or less makes it undefined."""
    path = Window.partitionBy(*by).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    safe = F.when(F.col("ret") > -1, F.log1p("ret"))
    return daily.withColumns({"nav": F.lit(cash) * F.exp(F.sum(safe).over(path)), "ruined": F.max((F.col("ret") <= -1)).over(path)})


def baseline(daily: DataFrame, by: Sequence[str], cash: float = 1.0) -> DataFrame:
    """(by, dt, nav) with the starting point one bar before the first return."""
    first = daily.where(F.col("ret").isNotNull()).groupBy(*by).agg(F.date_sub(F.min("dt"), 1).alias("dt")).withColumn("nav", F.lit(cash))
    return nav(daily.where(F.col("ret").isNotNull()), by, cash).select(*by, "dt", "nav").unionByName(first.select(*by, "dt", "nav"))


def metrics(daily: DataFrame, by: Sequence[str], config: Config) -> DataFrame:
    """The twelve metrics of each group. Ratios are null below two returns, +Infinity for a live, winning book without downside."""
    ppy = config.periods_per_year
    excess = F.col("ret") - config.risk_free / ppy
    valued = nav(daily.where(F.col("ret").isNotNull()), by)
    peak = F.greatest(F.lit(1.0), F.max("nav").over(Window.partitionBy(*by).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)))
    raw = valued.withColumn("drop", F.col("nav") / peak - 1).groupBy(*by).agg(
        F.count("ret").alias("n"), F.avg(excess).alias("mean_ex"), F.stddev_samp("ret").alias("sd"), F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), F.lit(2.0)))).alias("down"),
        F.sum(F.when(F.col("ret") > -1, F.log1p("ret"))).alias("growth"), F.min("drop").alias("low"), F.max("ruined").alias("ruined"),
        F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"), F.avg("turnover").alias("avg_turnover"), F.avg(F.abs("gross")).alias("avg_gross"), F.count_if(F.abs("gross") > ACTIVE).alias("n_active"),
    )
    enough = (F.col("n") >= 2) & ~F.col("ruined")
    cagr = F.when(enough, F.exp(F.col("growth") * ppy / F.col("n")) - 1)
    maxdd = F.when(enough, F.least(F.col("low"), F.lit(0.0)))
    rescued = (F.col("avg_gross") > ACTIVE) & (cagr > 0) & enough
    ratio = lambda top, bottom: F.when(enough & (F.abs(bottom) > ZERO), top / bottom).when(rescued & (F.abs(bottom) <= ZERO), F.lit(INF))
    root = ppy**0.5
    return raw.select(
        *by, ratio(F.col("mean_ex") * root, F.col("down")).alias("sortino"), ratio(F.col("mean_ex") * root, F.col("sd")).alias("sharpe"), ratio(cagr, F.abs(maxdd)).alias("calmar"),
        cagr.alias("cagr"), cagr.alias("ann_return"), maxdd.alias("maxdd"), F.when(enough, F.col("sd") * root).alias("ann_vol"), "hit_rate", "avg_turnover", "avg_gross", "n", "n_active",
    )


def objectives(spark) -> DataFrame:
    """(objective, higher_is_better, neutral, label)."""
    return spark.createDataFrame(OBJECTIVES, "objective string, higher_is_better boolean, neutral double, label string")


def long_metrics(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, objective, value, higher_is_better, neutral, label, goodness, is_good) for all objectives."""
    names = [o[0] for o in OBJECTIVES]
    long = table.select(*by, *names).unpivot(list(by), names, "objective", "value")
    joined = long.join(F.broadcast(objectives(table.sparkSession)), "objective")
    return joined.withColumns({"goodness": goodness(F.col("value"), F.col("higher_is_better")), "is_good": F.coalesce(F.when(F.col("higher_is_better"), F.col("value") > F.col("neutral")).otherwise(F.col("value") < F.col("neutral")), F.lit(False))})


def goodness(value: Column, higher: Column) -> Column:
    """Higher is better for all; an undefined value is the worst."""
    return F.coalesce(F.when(F.isnan(value), None).when(higher, value).otherwise(-value), F.lit(-INF))


def passes(value: Column, line: float, higher: bool) -> Column:
    return F.coalesce(~F.isnan(value) & ((value >= line) if higher else (value <= line)), F.lit(False))


def is_profitable(cagr: Column) -> Column:
    return F.coalesce(~F.isnan(cagr) & (cagr < INF) & (cagr > 0), F.lit(False))


def is_active(avg_gross: Column) -> Column:
    return F.coalesce(~F.isnan(avg_gross) & (avg_gross < INF) & (avg_gross > ACTIVE), F.lit(False))
