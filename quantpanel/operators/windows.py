"""In-sample and out-of-sample windows, research schedules and verdicts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantpanel.operators.metrics import is_active, is_profitable, passes
from quantpanel.schema import OBJECTIVES, Config

#: Unit of each offset alias, and months it covers.
UNITS = {"D": ("day", 0), "B": ("day", 0), "W": ("week", 0), "MS": ("month", 1), "ME": ("month", 1), "QS": ("quarter", 3), "QE": ("quarter", 3), "YS": ("year", 12), "YE": ("year", 12)}
#: Old spellings, which are refused.
OLD = {"M", "Q", "Y", "A", "AS", "BM", "BQ"}


def frequency(alias: str) -> tuple[int, str]:
    """(multiple, unit) of an offset alias such as QS, 2QS, 13W; anything below a day, backward or old is refused."""
    m = re.fullmatch(r"(-?\d+)?([A-Z]+)(?:-[A-Z]{3})?", alias)
    if not m or m[2] in OLD or m[2] not in UNITS or int(m[1] or 1) < 1:
        raise ValueError(f"not a forward frequency of a day or more: {alias!r}")
    return int(m[1] or 1), m[2]


def schedule(spark, start: str, end: str, alias: str = "YS") -> DataFrame:
    """(research_date) from start to end on the alias's anchors; an empty one is an error."""
    k, unit = frequency(alias)
    kind, months = UNITS[unit]
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))
    if unit == "B":
        days = days.where(F.weekday("d") < 5)
    elif unit == "W":
        days = days.where(F.dayofweek("d") == 1)
    elif unit.endswith("S"):
        days = days.where(F.col("d") == F.to_date(F.date_trunc(kind, "d")))
    elif unit.endswith("E"):
        days = days.where(F.date_add("d", 1) == F.to_date(F.date_trunc(kind, F.date_add("d", 1))))
    numbered = days.withColumn("n", F.row_number().over(Window.orderBy("d")))  # a row a day at most
    dates = numbered.where((F.col("n") - 1) % k == 0).select(F.col("d").alias("research_date"))
    if not dates.limit(1).count():
        raise ValueError("no research date in the schedule")
    return dates


def bar_numbers(calendar: DataFrame) -> DataFrame:
    return calendar.select("dt", F.row_number().over(Window.orderBy("dt")).alias("bar_no"))  # one row a date


def research_windows(dates: DataFrame, calendar: DataFrame, config: Config) -> DataFrame:
    """(research_date, is_start, is_end, oos_start, oos_end): years up to the date; then the next `oos_bars` bars, never past the day before the next date."""
    order = Window.orderBy("research_date")
    steps = dates.withColumn("next_date", F.lead("research_date").over(order))
    bars = F.broadcast(bar_numbers(calendar))
    at = steps.join(bars, F.col("dt") <= F.col("research_date"), "left").groupBy("research_date", "next_date").agg(F.coalesce(F.max("bar_no"), F.lit(0)).alias("at"))
    ends = at.join(bars, F.col("bar_no").between(F.col("at") + 1, F.col("at") + config.oos_bars), "left").groupBy("research_date", "next_date").agg(F.min("dt").alias("oos_start"), F.max("dt").alias("last"))
    limit = F.date_sub("next_date", 1)
    return ends.select("research_date", F.add_months("research_date", -12 * config.is_years).alias("is_start"), F.col("research_date").alias("is_end"), "oos_start", F.least("last", limit).alias("oos_end"))


def required_window(windows: DataFrame, calendar: DataFrame, warmup: int) -> DataFrame:
    """(need_from, need_to): all windows, and `warmup` bars before the first."""
    span = windows.agg(F.min("is_start").alias("lo"), F.max("oos_end").alias("need_to"))
    bars = F.broadcast(bar_numbers(calendar))
    first = span.join(bars, F.col("dt") >= F.col("lo")).groupBy("need_to").agg(F.min("bar_no").alias("first"))
    return first.join(bars, F.col("bar_no") == F.greatest(F.lit(1), F.col("first") - warmup)).select(F.col("dt").alias("need_from"), "need_to")


def in_phases(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """Daily rows by research date and phase (IS or OOS); OOS starts after the IS end. The windows are a few rows."""
    w = F.broadcast(windows)
    inside = F.col("dt").between(F.col("is_start"), F.col("is_end"))
    outside = (F.col("dt") > F.col("is_end")) & F.col("dt").between(F.col("oos_start"), F.col("oos_end"))
    return daily.join(w, inside | outside).withColumn("phase", F.when(inside, "IS").otherwise("OOS")).drop("is_start", "is_end", "oos_start", "oos_end")


def phase_bounds(phased: DataFrame) -> DataFrame:
    """First and last bar and their number, by candidate, research date and phase."""
    return phased.groupBy("candidate_id", "research_date", "phase").agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.count(F.lit(1)).alias("n_bars"))


def verdicts(scored: DataFrame, config: Config) -> DataFrame:
    """Adds passed, label, is_value, oos_value, reasons to rows with is_* and oos_* metrics. Out-of-sample decides."""
    _, higher, _, label = next(o for o in OBJECTIVES if o[0] == config.objective)
    value, oos = F.col(f"is_{config.objective}"), F.col(f"oos_{config.objective}")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    enough_is, enough_oos = n("is_n_active") >= config.min_is_bars, n("oos_n_active") >= config.min_oos_bars
    active = is_active(F.col("is_avg_gross")) & is_active(F.col("oos_avg_gross"))
    meets = passes(oos, config.pass_line, higher)
    profit = (is_profitable(F.col("is_cagr")) & is_profitable(F.col("oos_cagr"))) if config.require_profit else F.lit(True)
    few = lambda phase, count, least: F.format_string(f"insufficient {phase} observations with live exposure (%d < {least}; %d bar(s) scored)", n(count), n(f"{phase.lower()}_n"))
    shown = lambda c: F.when(c.isNull(), "nan").when(F.abs(c) < 1e6, F.format_string("%.4f", c)).otherwise(F.format_string("%.3e", c))
    reasons = F.array_compact(F.array(
        F.when(~enough_is, few("IS", "is_n_active", config.min_is_bars)), F.when(~enough_oos, few("OOS", "oos_n_active", config.min_oos_bars)),
        F.when(~active, F.lit("inactive strategy: average gross exposure is ~0")),
        F.when(~meets, F.concat(F.lit(f"OOS {label} "), shown(oos), F.lit(f" fails the pass line ({'>=' if higher else '<='} {config.pass_line})"))),
        F.when(~profit, F.concat(F.lit("IS/OOS not consistently profitable (IS "), shown(F.col("is_cagr")), F.lit(", OOS "), shown(F.col("oos_cagr")), F.lit(")"))),
    ))
    passed: Column = enough_is & enough_oos & active & meets & profit
    return scored.withColumns({"objective": F.lit(config.objective), "is_value": value, "oos_value": oos, "passed": passed, "label": F.when(passed, "PASS").otherwise("FAIL"), "reasons": reasons})
