"""From trades or bars to the dense panel: resampling, calendars, validity of symbols, VWAP, derived fields, wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantpanel.schema import FIELDS

OHLCV = ("open", "high", "low", "close", "volume")


def resample(trades: DataFrame, unit: str, key: Sequence[str], price: str = "price", volume: str = "volume", ts: str = "ts") -> DataFrame:
    """Bars of one `unit` (day, week, month) with a volume-weighted price. `key` orders trades and must be unique in a symbol."""
    k = F.struct(*key)
    return trades.groupBy("symbol", F.to_date(F.date_trunc(unit, F.col(ts))).alias("dt")).agg(
        F.min_by(price, k).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, k).alias("close"),
        F.sum(volume).alias("volume"), F.try_divide(F.sum(F.col(price) * F.col(volume)), F.sum(volume)).alias("vwap"),
    )


def calendar_of(bars: DataFrame) -> DataFrame:
    return bars.select("dt").distinct()


def densify(bars: DataFrame, calendar: DataFrame | None = None, symbols: DataFrame | None = None, fill: float | None = None) -> DataFrame:
    """A row for each calendar date and symbol. The calendar, a row a date, is the small side."""
    calendar = calendar_of(bars) if calendar is None else calendar
    symbols = bars.select("symbol").distinct() if symbols is None else symbols
    dense = symbols.crossJoin(F.broadcast(calendar)).join(bars, ["symbol", "dt"], "left")
    return dense if fill is None else dense.fillna(fill)


def usable_symbols(bars: DataFrame) -> DataFrame:
    """Symbols with at least one close."""
    return bars.groupBy("symbol").agg(F.count("close").alias("n")).where(F.col("n") > 0).select("symbol")


def missing_symbols(requested: DataFrame, bars: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Requested symbols without data; fatal unless they are allowed."""
    missing = requested.join(usable_symbols(bars), "symbol", "left_anti")
    if not allow_missing and (names := [r.symbol for r in missing.orderBy("symbol").limit(20).collect()]):
        raise ValueError(f"no data for {names}")
    return missing


def in_request_order(bars: DataFrame, requested: DataFrame) -> DataFrame:
    """Bars of the requested (symbol, symbol_ord), with the order as a column."""
    return bars.join(requested, "symbol")


def genuine_vwap(bars: DataFrame) -> DataFrame:
    """(genuine), one row: whether every symbol has some VWAP."""
    return bars.groupBy("symbol").agg(F.max(F.col("vwap").isNotNull()).alias("has")).agg(F.coalesce(F.bool_and("has"), F.lit(False)).alias("genuine"))


def chosen_vwap(bars: DataFrame, genuine: DataFrame) -> DataFrame:
    proxy = (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.crossJoin(F.broadcast(genuine)).withColumns({"vwap": F.when(F.col("genuine"), F.col("vwap")).otherwise(proxy), "vwap_source": F.when(F.col("genuine"), "source").otherwise("hlc3")}).drop("genuine")  # one row


def with_vwap(bars: DataFrame) -> DataFrame:
    """The source's VWAP only if every symbol has some, else the mean of high, low and close for all; vwap_source says which."""
    return chosen_vwap(bars, genuine_vwap(bars))


def with_derived(dense: DataFrame) -> DataFrame:
    """typical_price and returns on a dense panel; a return needs the close of the row before."""
    before = F.lag("close", 1).over(Window.partitionBy("symbol").orderBy("dt"))
    return dense.withColumns({"typical_price": (F.col("high") + F.col("low") + F.col("close")) / 3, "returns": F.try_divide(F.col("close"), before) - 1})


def panel(bars: DataFrame, source: str = "table", calendar: DataFrame | None = None) -> DataFrame:
    """The dense panel with derived fields and provenance. `bars` are read several times; hand over a written table."""
    clean = bars
    for c in (*OHLCV, "vwap"):
        clean = clean.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    # Where there is no bar, high, low and close are null, so the proxy is too.
    made = with_derived(chosen_vwap(densify(clean, calendar), genuine_vwap(clean)))
    return made.select("dt", "symbol", *FIELDS, F.concat(F.lit(f"{source}(vwap="), "vwap_source", F.lit(")")).alias("source"), "vwap_source")


def settlement(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Dense panel of settlement prices: close is the bar's VWAP, open the previous close."""
    flat = bars.select("symbol", "dt", F.col("vwap").alias("close"), "volume", "vwap")
    dense = densify(flat, calendar)
    series = Window.partitionBy("symbol").orderBy("dt")
    opened = dense.withColumn("open", F.lag("close", 1).over(series))
    return with_derived(opened.withColumns({"high": F.greatest("open", "close"), "low": F.least("open", "close")}))


def between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dates from start to end, both included."""
    if start is not None:
        df = df.where(F.col("dt") >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col("dt") <= F.lit(end).cast("date"))


def canonical(value: Column, kind: str, digits: int) -> Column:
    """A value as text that every engine writes alike: numbers as integers in units of 10 ** -digits, dates as yyyy-MM-dd."""
    if kind in ("double", "float"):
        # Beyond 15 digits a double has no such decimals; its leading ones and its exponent say what there is to know.
        power = F.floor(F.log10(F.abs(value)))
        large = F.concat(F.rint(value / F.pow(F.lit(10.0), power - 12)).cast("decimal(38,0)").cast("string"), F.lit("e"), power.cast("string"))
        small = F.rint(value * F.lit(10.0**digits)).cast("decimal(38,0)").cast("string")
        odd = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
        return F.coalesce(odd, F.when(F.abs(value) < 10.0 ** (15 - digits), small), F.when(value.isNotNull(), large), F.lit("-"))
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """(rows, total1, total2, version): equal for equal rows in any order, and the same in any engine that has SHA-256.

    A row's digest is that of its canonical texts, and two sums over the rows add up 60 bits of it each. Doubles count to
    `digits` decimals.
    """
    kinds = dict(df.dtypes)
    row = F.sha2(F.concat_ws("|", *(canonical(F.col(c), kinds[c], digits) for c in columns)), 256)
    word = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    digest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(word(1), F.lit(0)).cast("string").alias("total1"), F.coalesce(word(16), F.lit(0)).cast("string").alias("total2"))
    return digest.withColumn("version", F.sha2(F.concat_ws("|", "rows", "total1", "total2"), 256))


def wall_clock(text: Column) -> Column:
    """A time string without its offset, read as local wall clock."""
    return F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", ""), "T", " "))


def wide(df: DataFrame, symbols: Sequence[str], fields: Sequence[str] = ("open", "close")) -> DataFrame:
    """Columns {SYMBOL}_{field}; an export, never the working form."""
    return df.groupBy("dt").pivot("symbol", list(symbols)).agg(*(F.first(f).alias(f) for f in fields))


def from_wide(df: DataFrame, time: str = "Datetime") -> DataFrame:
    """Long bars from columns {SYMBOL}_{Field}; text that is no number or time is null."""
    names = [c for c in df.columns if c != time]
    cells = df.select(time, *(F.col(f"`{c}`").cast("string").alias(c) for c in names)).unpivot([time], names, "name", "value")
    parts = F.regexp_extract("name", r"^(.*)_([^_]+)$", 1), F.lower(F.regexp_extract("name", r"^(.*)_([^_]+)$", 2))
    long = cells.select(F.to_date(F.try_to_timestamp(F.col(time).cast("string"))).alias("dt"), parts[0].alias("symbol"), parts[1].alias("field"), F.expr("try_cast(value AS double)").alias("value"))
    fields = [*OHLCV, "vwap"]
    return long.where(F.col("dt").isNotNull()).groupBy("dt", "symbol").pivot("field", fields).agg(F.first("value"))


def axis_faults(df: DataFrame) -> DataFrame:
    """(symbol, dt, n) that stand more than once; must be empty."""
    return df.groupBy("symbol", "dt").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def business_days(df_or_spark, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Monday to Friday from start to end, without the `holidays` (dt)."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("dt")).where(F.weekday("dt") < 5)
    return days if holidays is None else days.join(F.broadcast(holidays), "dt", "left_anti")


def session_bounds(days: DataFrame, start: str, end: str) -> DataFrame:
    return between(days, start, end).agg(F.min("dt").alias("first_session"), F.max("dt").alias("last_session"))


def source_calendar(symbols: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The one calendar that the symbols' suffixes (suffix, calendar) name; several or none give null."""
    suffix = F.coalesce(F.nullif(F.regexp_extract("symbol", r"\.([A-Z]+)$", 1), F.lit("")), F.lit("-"))
    named = symbols.withColumn("suffix", suffix).join(F.broadcast(suffixes), "suffix", "left")
    return named.agg(F.count_distinct("calendar").alias("n"), F.min("calendar").alias("one"), F.count_if(F.col("calendar").isNull()).alias("unknown")).select(F.when((F.col("n") == 1) & (F.col("unknown") == 0), F.col("one")).alias("calendar"), "n", "unknown")


def coverage(bars: DataFrame, need_from: str, need_to: str) -> DataFrame:
    """First and last bar against the window that is needed."""
    return bars.agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")).select("first_dt", "last_dt", (F.col("first_dt") <= F.lit(need_from).cast("date")).alias("covers_start"), (F.col("last_dt") >= F.lit(need_to).cast("date")).alias("covers_end"))


def symbol_list(df: DataFrame, text: str, presets: DataFrame | None = None) -> DataFrame:
    """(symbol) of comma-separated lists; a name of `presets` (name, symbols) stands for its list."""
    if presets is not None:
        df = df.join(F.broadcast(presets), F.trim(F.col(text)) == F.col("name"), "left").withColumn(text, F.coalesce("symbols", text))
    return df.select(F.explode(F.split(text, ",")).alias("symbol")).select(F.trim("symbol").alias("symbol")).where("symbol <> ''").distinct()
