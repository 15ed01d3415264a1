"""Validity of signals: faults, masks, coverage. A signal is (candidate_id, dt, symbol, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantpanel.operators.panel import fingerprint


def non_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def truncated(panel: DataFrame, end: str) -> DataFrame:
    """No row after `end`; to be applied below all windows, so that nothing after it can matter."""
    return panel.where(F.col("dt") <= F.lit(end).cast("date"))


def node_report(df: DataFrame, nodes: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """(node, cells, invalid_cells, faults): masked cells and non-finite values of each column in one pass."""
    if start:
        df = df.where(F.col("dt") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("dt") <= F.lit(end).cast("date"))
    long = df.select("dt", "symbol", *nodes).unpivot(["dt", "symbol"], list(nodes), "node", "value")
    return long.groupBy("node").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("value").isNull()).alias("invalid_cells"), F.count_if(non_finite(F.col("value"))).alias("faults"))


def validity(columns: Sequence[str]) -> dict[str, Column]:
    """Aggregates of the cells of a candidate and date: valid, faulty, low, high: what decides on a signal.

    Cells with a `fault` column (faults of the nodes below) are faulty there too.
    """
    fault = F.coalesce(non_finite(F.col("value")), F.lit(False))
    if "fault" in columns:
        fault = fault | F.col("fault")
    return {"valid": F.count("value"), "faulty": F.count_if(fault), "low": F.min("value"), "high": F.max("value")}


def daily_validity(signals: DataFrame) -> DataFrame:
    """(candidate_id, dt, valid, faulty, low, high), a row a candidate and date."""
    return signals.groupBy("candidate_id", "dt").agg(*(x.alias(n) for n, x in validity(signals.columns).items()))


def outcome() -> Column:
    """NUMERICAL_NONFINITE, VALID_COVERAGE (no valid cell) and DEGENERATE_SIGNAL (all equal) reject; else ADMITTED."""
    return F.when(F.col("faults") > 0, "NUMERICAL_NONFINITE").when(F.col("valid_cells") == 0, "VALID_COVERAGE").when(F.col("low") == F.col("high"), "DEGENERATE_SIGNAL").otherwise("ADMITTED")


SCOPE = (F.sum, "valid", "valid_cells"), (F.sum, "faulty", "faults"), (F.min, "low", "low"), (F.max, "high", "high")


def admission(signals: DataFrame, start: str, end: str) -> DataFrame:
    """One row a candidate: valid cells in scope, faults, and the outcome."""
    scope = daily_validity(signals.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    seen = scope.groupBy("candidate_id").agg(*(f(x).alias(name) for f, x, name in SCOPE))
    return seen.select("candidate_id", "valid_cells", "faults", outcome().alias("outcome"))


def admission_by_date(validity: DataFrame, windows: DataFrame) -> DataFrame:
    """(candidate_id, research_date, valid_cells, faults, outcome, oos_faults): admission in each date's in-sample window.

    Windows join the daily rows, so dates never multiply cells. Operators look back only, so what comes after a window
    can't change what is in it.
    """
    inside = F.col("dt").between(F.col("is_start"), F.col("is_end"))
    outside = (F.col("dt") > F.col("is_end")) & F.col("dt").between(F.col("oos_start"), F.col("oos_end"))
    joined = validity.join(F.broadcast(windows), inside | outside).withColumn("inside", inside)  # a row a date
    within = lambda x: F.when(F.col("inside"), F.col(x))
    seen = joined.groupBy("candidate_id", "research_date").agg(*(F.coalesce(f(within(x)), F.lit(0)).alias(name) if f is F.sum else f(within(x)).alias(name) for f, x, name in SCOPE), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("faulty"))).alias("oos_faults"))
    return seen.select("candidate_id", "research_date", "valid_cells", "faults", outcome().alias("outcome"), "oos_faults")


def signal_hash(signals: DataFrame) -> DataFrame:
    """Content hash of each candidate's signal, to be compared before use."""
    return fingerprint(signals, ["dt", "symbol", "value"], ["candidate_id"])


def require_genuine_vwap(panel: DataFrame) -> DataFrame:
    """The panel itself; raises if its VWAP is only a proxy."""
    if panel.where(F.col("vwap_source") != "source").limit(1).count():
        raise ValueError("vwap is a proxy here")
    return panel
