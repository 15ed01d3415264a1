"""The catalog of factor shapes and their evaluation: many candidates in one plan.

Time operators of all candidates share one window sort by symbol; then candidates become rows, and everything across
symbols or days is grouped by candidate_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantpanel.functions import cross, elementwise, timeseries
from quantpanel.operators.quality import non_finite

#: candidate_id, shape, field, second field, w1, w2, final cross-sectional operator, operators used, expected sign.
CATALOG = [
    ("k1_volume", "raw", "volume", None, 0, 0, "rank", ["rank"], 1),
    ("k2_range", "spread", "high", "low", 0, 0, "rank", ["sub", "rank"], -1),
    ("k3_gap_mean", "baseline_mean", "close", None, 8, 0, "zscore", ["sub", "ts_mean", "zscore"], -1),
    ("k3_reversal", "baseline_delay", "close", None, 4, 0, "rank", ["neg", "delta", "rank"], 1),
    ("k4_mean_gap", "mean_gap", "close", None, 4, 16, "rank", ["ts_mean", "sub", "rank"], 1),
    ("k5_deviation", "deviation", "close", None, 8, 8, "rank", ["neg", "sub", "ts_mean", "ts_std", "div", "rank"], 1),
    ("k6_location", "location", "returns", None, 8, 8, "rank", ["ts_mean", "ts_std", "div", "rank"], 1),
    ("k7_range_ratio", "ratio", "high", "low", 0, 0, "rank", ["sub", "div", "rank"], 1),
    ("k8_corr", "corr", "close", "volume", 8, 0, "rank", ["ts_corr", "rank"], -1),
    ("k9_vwap_spread", "spread", "close", "vwap", 0, 0, "rank", ["sub", "rank"], -1),
]
COLUMNS = "candidate_id string, shape string, field string, field2 string, w1 int, w2 int, final string, ops array<string>, expected_sign int"


def catalog(spark: SparkSession, rows=CATALOG) -> DataFrame:
    """The catalog with `candidate`, its order, and expression_hash, its identity."""
    numbered = [(*r, i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, COLUMNS + ", candidate int")
    return df.withColumn("expression_hash", F.sha2(F.to_json(F.struct("shape", "field", "field2", "w1", "w2", "final")), 256))


class Nodes(dict):
    """Inner nodes by name, as columns over the panel: each is computed once, whichever shapes and checks use it."""

    def take(self, kind: str, *of) -> Column:
        name = " ".join(map(str, (kind, *of)))
        if name not in self:
            x, y, w = F.col(of[0]), F.col(of[1]) if len(of) == 3 else None, of[-1]
            self[name] = {
                "mean": lambda: timeseries.ts_mean(x, w), "spread": lambda: timeseries.ts_std(x, w), "before": lambda: timeseries.delay(x, w),
                "covariance": lambda: timeseries.ts_cov(x, y, w), "spread beside": lambda: timeseries.full(y, w, timeseries.ts_std(x, w)),
            }[kind]()
        return F.col(f"`{name}`")


def raw_value(nodes: Nodes, shape: str, a: str, b: str | None, w1: int, w2: int) -> tuple[Column, list[Column]]:
    """The value of a shape, and the inner nodes that have to be finite for it: an overflow in one may not show in the value."""
    x = F.col(a)
    if shape == "raw":
        return x, []
    if shape == "spread":
        return x - F.col(b), []
    if shape == "ratio":
        return elementwise.div(x - F.col(b), F.col("close")), [x - F.col(b), F.col("close")]
    if shape == "baseline_mean":
        mean = nodes.take("mean", a, w1)
        return x - mean, [mean]
    if shape == "baseline_delay":
        return nodes.take("before", a, w1) - x, []
    if shape == "mean_gap":
        near, far = nodes.take("mean", a, w1), nodes.take("mean", a, w2)
        return near - far, [near, far]
    if shape in ("deviation", "location"):
        mean, spread = nodes.take("mean", a, w1), nodes.take("spread", a, w2)
        return (-elementwise.div(x - mean, spread) if shape == "deviation" else elementwise.div(mean, spread)), [mean, spread]
    if shape == "corr":
        both = [nodes.take("spread beside", a, b, w1), nodes.take("spread beside", b, a, w1)]
        covariance = nodes.take("covariance", a, b, w1)
        return F.try_divide(covariance, both[0] * both[1]), [*both, covariance]
    raise ValueError(f"unknown shape {shape!r}")


#: Final operators: the value across the symbols of a date, and the node it divides by.
FINALS = {
    "rank": (cross.rank, None), "demean": (cross.demean, None), "none": (lambda x, by: x, None),
    "zscore": (cross.zscore, lambda x, by: F.stddev_samp(x).over(Window.partitionBy(*by))),
    "scale": (lambda x, by: cross.scale(x, by=by), lambda x, by: F.sum(F.abs(x)).over(Window.partitionBy(*by))),
}


def is_fault(*nodes: Column) -> Column:
    """Whether any of the nodes is infinite or not a number; one that is masked is none."""
    return reduce(lambda a, b: a | b, [F.coalesce(non_finite(x), F.lit(False)) for x in nodes])


def raw_signals(panel: DataFrame, rows=CATALOG, faults: bool = False) -> DataFrame:
    """(candidate_id, dt, symbol, raw): all time operators in one pass, then candidates as rows.

    With `faults`, also fault: whether an input of the cell, an inner node or its raw value is infinite or not a number.
    """
    if bad := [r[0] for r in rows if r[6] not in FINALS]:
        raise ValueError(f"unknown final operator of {bad}")
    key, names, nodes = ["dt", "symbol"], [r[0] for r in rows], Nodes()
    cells = {r[0]: (*raw_value(nodes, *r[1:6]), [F.col(n) for n in r[2:4] if n]) for r in rows}
    made = panel.withColumns(nodes) if nodes else panel
    if not faults:
        return made.select(*key, *(value.alias(n) for n, (value, _, _) in cells.items())).unpivot(key, names, "candidate_id", "raw")
    judged = {n: F.struct(value.alias("raw"), is_fault(value, *inner, *inputs).alias("fault")) for n, (value, inner, inputs) in cells.items()}
    return made.select(*key, *(x.alias(n) for n, x in judged.items())).unpivot(key, names, "candidate_id", "cell").select("candidate_id", *key, "cell.raw", "cell.fault")


def signals(panel: DataFrame, rows=CATALOG, faults: bool = False, adjust: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(candidate_id, dt, symbol, value); with `faults` as in raw_signals, as a rank hides what was infinite before it.

    A dispersion across symbols that is infinite or not a number is a fault of all cells of its date. `adjust` changes raw
    values before they are compared across symbols.
    """
    section = ("candidate_id", "dt")
    raw = raw_signals(panel, rows, faults).withColumn("raw", adjust(F.col("raw")))
    value, divisor, x = F.col("raw"), F.lit(None).cast("double"), F.col("raw")
    for final in dict.fromkeys(r[6] for r in rows):
        mine = F.col("candidate_id").isin([r[0] for r in rows if r[6] == final])
        of_dates, node = FINALS[final]
        value = F.when(mine, of_dates(x, section)).otherwise(value)
        divisor = F.when(mine, node(x, section)).otherwise(divisor) if node else divisor
    fault = [(F.col("fault") | is_fault(divisor)).alias("fault")] if faults else []
    return raw.select("candidate_id", "dt", "symbol", value.alias("value"), *fault)
