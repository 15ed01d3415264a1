"""Recursive averages and weighted windows along a series, in time that is linear in its rows.

A recurrence y' = c * y + o is a map of y; maps compose, so a series is cut into chunks and chunks into super-chunks. A row
composes the maps of its chunk up to itself; the first row of a chunk also those of the chunks before it in its super-chunk
and of the super-chunks before that one: per row some CHUNK / 2 + rows / CHUNK ** 3 small steps. A weighted window is the running sum of its own block and the rest of the block before it, each rescaled to the
row: no window is folded, nothing is subtracted, and a value that isn't finite reaches the windows that hold it and no others.

All of it are window expressions on one partitioning by the series; `df` has a row a bar (dt) and series (`by`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantpanel.functions.timeseries import SYMBOL, series, width

CHUNK = 32
#: Half-lives in a window; beyond it the rescaling weights leave the range of a double.
MOST_HALVINGS = 900
BEFORE, SO_FAR = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)


def composed(first: Column, then: Column) -> Column:
    return F.struct((first["c"] * then["c"]).alias("c"), (first["o"] * then["c"] + then["o"]).alias("o"))


def all_of(maps: Column) -> Column:
    """One map that does what the maps of an array do, in order."""
    return F.aggregate(maps, F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("o")), composed)


def recurrences(df: DataFrame, steps: Mapping[str, tuple[Column, Column]], valid: Column, by: Sequence[str] = SYMBOL, chunk: int = CHUNK) -> DataFrame:
    """Adds for each name y = c * (y of the valid row before, 0 at first) + o by its (c, o); null on rows that aren't valid."""
    names, whole = list(steps), (*by, "_ok")
    made = df.withColumn("_ok", valid).withColumns({f"_m_{n}": F.struct(c.cast("double").alias("c"), o.cast("double").alias("o")) for n, (c, o) in steps.items()})
    made = made.withColumn("_n", F.row_number().over(series(whole)) - 1).withColumns({"_k": F.expr(f"_n div {chunk}"), "_s": F.expr(f"_n div {chunk * chunk}")})
    inside = series((*whole, "_s", "_k")).rowsBetween(*SO_FAR)
    made = made.withColumns({f"_m_{n}": all_of(F.collect_list(f"_m_{n}").over(inside)) for n in names})
    # Only the last row of a (super-)chunk carries the map of all of it; what came before is composed where a chunk begins.
    begins, ends, closes = F.col("_n") % chunk == 0, F.col("_n") % chunk == chunk - 1, F.col("_n") % (chunk * chunk) == chunk * chunk - 1
    chunks = {n: F.collect_list(F.when(ends, F.col(f"_m_{n}"))).over(series((*whole, "_s")).rowsBetween(*BEFORE)) for n in names}
    made = made.withColumns({f"_b_{n}": F.when(begins | closes, all_of(x)) for n, x in chunks.items()})
    supers = {n: F.collect_list(F.when(closes, composed(F.col(f"_b_{n}"), F.col(f"_m_{n}")))).over(series(whole).rowsBetween(*BEFORE)) for n in names}
    made = made.withColumns({f"_b_{n}": F.when(begins, composed(all_of(x), F.col(f"_b_{n}"))["o"]) for n, x in supers.items()})
    made = made.withColumns({f"_b_{n}": F.first(f"_b_{n}").over(inside) for n in names})
    found = {n: F.when(F.col("_ok"), F.col(f"_m_{n}")["c"] * F.col(f"_b_{n}") + F.col(f"_m_{n}")["o"]) for n in names}
    return made.withColumns(found).drop("_ok", "_n", "_k", "_s", *(f"_{k}_{n}" for k in "mb" for n in names))


def smoothed(df: DataFrame, averages: Mapping[str, tuple[Column, float]], valid: Column, by: Sequence[str] = SYMBOL) -> DataFrame:
    """Adds exponential averages: name -> (value, weight of the newest); each starts at its first valid value."""
    marked = df.withColumn("_valid", valid)
    first = marked.withColumn("_first", F.row_number().over(series((*by, "_valid"))) == 1)
    steps = {n: (F.lit(1.0 - a), F.when(F.col("_first"), x).otherwise(x * a)) for n, (x, a) in averages.items()}
    return recurrences(first, steps, F.col("_valid"), by).drop("_valid", "_first")


def blocked(df: DataFrame, window: int, by: Sequence[str]) -> DataFrame:
    """Adds _block and _pos: every `window` rows of a series are a block."""
    numbered = df.withColumn("_row", F.row_number().over(series(by)) - 1)
    return numbered.withColumns({"_block": F.expr(f"_row div {window}"), "_pos": F.col("_row") % window}).drop("_row")


def head_and_tail(by: Sequence[str]):
    """Frames of what a block holds up to a row, and from it on."""
    block = Window.partitionBy(*by, "_block")
    return block.orderBy("dt").rowsBetween(*SO_FAR), block.orderBy(F.desc("dt")).rowsBetween(*SO_FAR)


def halved_sums(df: DataFrame, sums: Mapping[str, Column], window: int, half_life: float, lag: int = 0, by: Sequence[str] = SYMBOL) -> DataFrame:
    """Adds sums over the `window` rows that end `lag` rows ago, with weights that halve every `half_life` rows; null counts as 0.

    Null where the series is shorter than the window.
    """
    if width(window) / half_life > MOST_HALVINGS:
        raise ValueError(f"a window of {window} rows has more than {MOST_HALVINGS} half-lives of {half_life}")
    made = blocked(df, window, by)
    up_to, from_on = head_and_tail(by)
    grown = lambda e: F.pow(F.lit(2.0), e / F.lit(float(half_life)))
    pos = F.col("_pos")
    xs = {n: F.coalesce(x.cast("double"), F.lit(0.0)) for n, x in sums.items()}
    made = made.withColumns({f"_h_{n}": F.sum(x * grown(pos)).over(up_to) * grown(-pos) for n, x in xs.items()} | {f"_t_{n}": F.sum(x * grown(pos - (window - 1))).over(from_on) for n, x in xs.items()})
    rest = {n: F.when(pos == window - 1, 0.0).otherwise(F.lag(f"_t_{n}", window - 1).over(series(by)) * grown(-(pos + 1))) for n in xs}
    made = made.withColumns({n: F.col(f"_h_{n}") + r for n, r in rest.items()})
    if lag:
        made = made.withColumns({n: F.lag(n, lag).over(series(by)) for n in xs})
    return made.drop("_block", "_pos", *(f"_{k}_{n}" for k in "ht" for n in xs))


def linear_decay(df: DataFrame, name: str, x: Column, d: int, by: Sequence[str] = SYMBOL) -> DataFrame:
    """Adds the mean with weights 1 .. d, the newest heaviest, where all d values are valid."""
    made = blocked(df.withColumn("_x", x.cast("double")), width(d), by)
    up_to, from_on = head_and_tail(by)
    pos, value = F.col("_pos"), F.coalesce("_x", F.lit(0.0))
    made = made.withColumns({f"_{k}{p}": F.sum(value * pos if p else value).over(frame) for k, frame in (("h", up_to), ("t", from_on)) for p in (0, 1)})
    before = lambda c: F.lag(c, d - 1).over(series(by))
    rest = F.when(pos == d - 1, 0.0).otherwise(before("_t1") - pos * before("_t0"))
    total = ((F.lit(d) - pos) * F.col("_h0") + F.col("_h1") + rest) / F.lit(d * (d + 1) / 2)
    ready = F.count("_x").over(series(by).rowsBetween(-(d - 1), 0)) == d
    return made.withColumn(name, F.when(ready, total)).drop("_x", "_block", "_pos", "_h0", "_h1", "_t0", "_t1")
