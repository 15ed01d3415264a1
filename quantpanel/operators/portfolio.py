"""Weight books and their replay into daily returns. All tables carry candidate_id; a signal is (candidate_id, dt, symbol, value).

Choices where no formula is published: top_q keeps ceil(q * names of the side), ties go to the first symbol; entries of
`hold_every` bars are summed and scaled back to the gross budget; the replay trades at the open and earns close to close.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantpanel.functions import cross
from quantpanel.operators.quality import validity
from quantpanel.schema import Config

SECTION = ("candidate_id", "dt")
def own_rows():
    return Window.partitionBy("candidate_id", "symbol").orderBy("dt")


def strengths(signals: DataFrame, gross: float = 1.0, keep: bool = False) -> DataFrame:
    """Dollar-neutral strength s: demeaned across symbols, scaled to sum |s| = gross. With `keep`, value stays."""
    centred = signals.withColumn("s", cross.demean(F.col("value"), SECTION))
    return centred.withColumn("s", cross.scale(F.col("s"), gross, SECTION)).drop(*([] if keep else ["value"]))


def select_names(book: DataFrame, config: Config) -> DataFrame:
    """Keeps the strongest names of each side (top_k or top_q) and scales the rest of the book to the gross budget."""
    if config.selection == "all":
        return book
    side = Window.partitionBy("candidate_id", "dt", F.signum("s"))
    place = F.row_number().over(side.orderBy(F.abs("s").desc_nulls_last(), "symbol"))
    limit = F.lit(config.top_k) if config.selection == "top_k" else F.ceil(F.lit(config.top_q) * F.count(F.when(F.col("s") != 0, 1)).over(side))
    kept = book.withColumn("s", F.when((place <= limit) & (F.col("s") != 0), F.col("s")))
    return kept.withColumn("s", cross.scale(F.col("s"), config.gross, SECTION))


def capped(book: DataFrame, gross: float) -> DataFrame:
    """Rows above the gross budget are scaled down to it, once; others stay."""
    total = F.sum(F.abs("s")).over(Window.partitionBy(*SECTION))
    return book.withColumn("s", F.col("s") * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(gross), total), F.lit(1.0))))


def entries(book: DataFrame, config: Config) -> DataFrame:
    """New entries on every `rebalance_every`-th bar; an entry stays `hold_every` bars."""
    if config.rebalance_every == config.hold_every == 1:
        return book
    # Bars are numbered on a row a candidate and date, not on cells.
    bars = book.select(*SECTION).distinct().withColumn("bar_no", F.row_number().over(Window.partitionBy("candidate_id").orderBy("dt")) - 1)
    entered = book.join(bars, list(SECTION)).withColumn("s", F.when(F.col("bar_no") % config.rebalance_every == 0, F.col("s")))
    held = entered.withColumn("s", F.sum("s").over(own_rows().rowsBetween(-(config.hold_every - 1), 0))).drop("bar_no")
    return held.withColumn("s", cross.scale(F.col("s"), config.gross, SECTION))


def weights(signals: DataFrame, config: Config, keep: bool = False) -> DataFrame:
    """(candidate_id, dt, symbol, w): the executed book, one bar after the signal; no position where there is none.

    With `keep`, the columns of the signal stay beside it.
    """
    book = capped(entries(select_names(strengths(signals, config.gross, keep), config), config), config.gross)
    return book.withColumn("w", F.coalesce(F.lag("s", 1).over(own_rows()), F.lit(0.0))).drop("s")


def priced(book: DataFrame, panel: DataFrame) -> DataFrame:
    """The book with `x` (close over open) and `g` (open over the close before), without a move where a price is missing."""
    before = F.lag("close", 1).over(Window.partitionBy("symbol").orderBy("dt"))
    moves = panel.select("symbol", "dt", F.coalesce(F.try_divide("close", "open") - 1, F.lit(0.0)).alias("x"), F.coalesce(F.try_divide(F.col("open"), before), F.lit(1.0)).alias("g"))
    return book.join(moves, ["symbol", "dt"])


def settle_delisted(panel: DataFrame) -> DataFrame:
    """On the first bar of a missing open the open and close are the last close before it; later bars stay missing. Only the past is read."""
    series = Window.partitionBy("symbol").orderBy("dt")
    last = F.last("close", ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1))
    first = F.col("open").isNull() & F.lag("open", 1).over(series).isNotNull()
    return panel.withColumns({"settled": F.coalesce(first, F.lit(False)), "open": F.when(first, last).otherwise(F.col("open")), "close": F.when(first, last).otherwise(F.col("close"))})


def replay(book: DataFrame, panel: DataFrame, cost_bps: float = 0.0, passes: int = 2) -> DataFrame:
    """(candidate_id, dt, ret, turnover, gross) of a book with a row for each date of its symbols.

    Closed form with costs c = rate * turnover: the weights carried over a bar depend on the cost of the bar before, so each
    pass takes the costs of the pass before it (the first none). One pass is exact without costs; two err by some 1e-9.

    What a pass needs of a symbol doesn't depend on costs: its weight and the value it carried from its row before. A
    date's symbols therefore become one row, and passes run over a candidate's dates alone: the value of the whole book at
    the last close (`base`) and what prices did over night (`gap`) scale all that was carried.

    A book that kept its signal also gives each date's valid, faulty, low and high (see quality.validity), so that a signal
    is evaluated once for both.
    """
    rate = cost_bps / 1e4
    kept = F.coalesce(F.lag(F.col("w") * (1 + F.col("x")), 1).over(own_rows()), F.lit(0.0))
    cells = priced(book, panel).withColumn("kept", kept)
    known = validity(book.columns) if "value" in book.columns else {}
    daily = cells.groupBy(*SECTION).agg(
        *(x.alias(n) for n, x in known.items()),
        F.collect_list(F.struct("w", (F.col("kept") * F.col("g")).alias("held"))).alias("cells"), F.sum(F.col("kept") * (F.col("g") - 1)).alias("gap"), F.sum(F.col("w") * F.col("x")).alias("intra"), F.sum(F.abs("w")).alias("gross")
    )
    dates = Window.partitionBy("candidate_id").orderBy("dt")
    daily = daily.withColumn("c", F.lit(0.0))
    for _ in range(passes if rate else 1):
        daily = daily.withColumn("base", F.lag(1 - F.col("c") + F.col("intra"), 1, 1.0).over(dates))
        # A book that lost all its value carries nothing on.
        scale = F.when(F.col("base") == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("base") + F.col("gap")))
        daily = daily.withColumn("scale", scale).withColumn("turnover", F.aggregate("cells", F.lit(0.0), lambda s, x: s + F.abs(x.w - x.held * F.col("scale"))))
        daily = daily.withColumn("c", F.col("turnover") * rate)
    night = F.coalesce(F.try_divide(F.col("gap"), F.col("base")), F.lit(0.0))
    return daily.select(*SECTION, ((1 + night) * (1 - F.col("c") + F.col("intra")) - 1).alias("ret"), "turnover", "gross", *known)


def unlagged_return(signals: DataFrame, panel: DataFrame, gross: float = 1.0) -> DataFrame:
    """(candidate_id, dt, cheat): the return of a book that knows its own bar; an honest book must earn far less."""
    book = strengths(signals, gross).withColumn("w", F.coalesce("s", F.lit(0.0)))
    return priced(book, panel).groupBy(*SECTION).agg(F.sum(F.col("w") * F.col("x")).alias("cheat"))
