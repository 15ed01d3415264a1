"""The registered queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantpanel.functions import cross as X
from quantpanel.functions import elementwise as E
from quantpanel.functions import recurrences as R
from quantpanel.functions import timeseries as T
from quantpanel.operators import diagnostics as D
from quantpanel.operators import indicators as I
from quantpanel.operators import metrics as M
from quantpanel.operators import panel as P
from quantpanel.operators import portfolio as B
from quantpanel.operators import quality as Q
from quantpanel.operators import windows as V
from quantpanel.plans import journal as J
from quantpanel.plans import research as G
from quantpanel.plans.candidates import CATALOG, catalog, signals
from quantpanel.schema import FIELDS, Config
from quantpanel.sources import bars as S
from quantpanel.sources.tables import brand_bars, brand_panel, brand_settlement, brand_trades, event_bars, shared_dir, table, version

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6
CONFIG = Config()
START, END = "1992-01-06", "1998-12-28"

# --- SQL pieces ---------------------------------------------------------------------------------------------------------
KEY = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


def bars_sql(unit: str = "week") -> str:
    return f"""trades AS (SELECT p_brand AS symbol, l_extendedprice / l_quantity AS px, lineitem.* FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0),
bars AS (SELECT symbol, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS dt, first(px ORDER BY {KEY}) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY {KEY}) AS close,
  sum(l_quantity) AS volume, sum(px * l_quantity) / sum(l_quantity) AS vwap FROM trades GROUP BY ALL)"""


DENSE = """dense AS (SELECT s.symbol, c.dt, b.open, b.high, b.low, b.close, b.volume, b.vwap FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT dt FROM bars) c LEFT JOIN bars b ON b.symbol = s.symbol AND b.dt = c.dt)"""
PANEL = f"""{bars_sql()},
{DENSE},
panel AS (SELECT *, (high + low + close) / 3 AS typical_price, close / lag(close) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS returns FROM dense)"""
SETTLED = f"""{bars_sql()},
dense AS (SELECT s.symbol, c.dt, b.vwap AS close, b.volume, b.vwap FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT dt FROM bars) c LEFT JOIN bars b ON b.symbol = s.symbol AND b.dt = c.dt),
opened AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY dt) AS open FROM dense),
panel AS (SELECT symbol, dt, open, CASE WHEN coalesce(open, close) IS NULL THEN NULL ELSE greatest(coalesce(open, close), coalesce(close, open)) END AS high, CASE WHEN coalesce(open, close) IS NULL THEN NULL ELSE least(coalesce(open, close), coalesce(close, open)) END AS low, close, volume, vwap, close / open - 1 AS returns FROM opened)"""


def frame_sql(d: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


def full_sql(agg: str, d: int, *xs: str) -> str:
    ready = " AND ".join(f"count({x}) {frame_sql(d)} = {d}" for x in xs)
    return f"CASE WHEN {ready} THEN {agg} END"


def near(x: Column, digits: int = DIGITS) -> Column:
    """Rounded to even in binary arithmetic, which both engines do alike; decimal rounding differs on ties."""
    return F.rint(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def near_sql(sql: str) -> str:
    """round(x, n) of the SQL above as the same arithmetic."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner, digits = sql[m.end() : i - 1].rsplit(",", 1)
        scale = f"1e{digits.strip()}::DOUBLE"
        out += [sql[at : m.start()], f"(round_even(({near_sql(inner)}) * {scale}, 0) / {scale})"]
        at = i
    return "".join(out) + sql[at:]


def cells(name: str, value: Callable[[], Column], sql: str, panel: Query = brand_panel, prefix: str = PANEL) -> None:
    """Registers a query of (symbol, dt, value)."""
    QUERIES[name] = lambda spark, sf_dir: panel(spark, sf_dir).select("symbol", "dt", near(value()).alias("value"))
    SQL[name] = f"WITH {prefix}\nSELECT symbol, dt, round({sql}, {DIGITS}) AS value FROM panel"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*(near(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


c = F.col
# --- elementwise --------------------------------------------------------------------------------------------------------
cells("e1_neg", lambda: E.neg(c("returns")), "-returns")
cells("e2_sub", lambda: E.sub(c("high"), c("low")), "high - low")
cells("e3_mul", lambda: E.mul(c("returns"), 2.5), "returns * 2.5::DOUBLE")
cells("e4_div", lambda: E.div(c("returns"), c("volume") - 1), "returns / nullif(volume - 1, 0)")
cells("e4_div_scalar", lambda: E.div(1.0, c("returns")), "1::DOUBLE / nullif(returns, 0)")
cells("e5_add", lambda: E.add(c("open"), c("close")), "open + close")
cells("e6_abs", lambda: E.absolute(c("returns")), "abs(returns)")
cells("e7_sign", lambda: E.sign(c("returns")), "sign(returns)::DOUBLE")
cells("e8_signed_log1p", lambda: E.signed_log1p(c("returns")), "sign(returns) * ln(1 + abs(returns))")
cells("e9_pow", lambda: E.power(c("returns"), 0.5), "CASE WHEN returns >= 0 THEN pow(CASE WHEN returns >= 0 THEN returns END, 0.5::DOUBLE) END")
cells("e9_pow_negative", lambda: E.power(c("volume"), -1), "CASE WHEN volume <> 0 THEN pow(CASE WHEN volume <> 0 THEN volume END, -1::DOUBLE) END")
cells("e10_signed_pow", lambda: E.signed_power(c("returns"), 2), "sign(returns) * pow(abs(returns), 2::DOUBLE)")
cells("e11_min", lambda: E.at_most(c("returns"), 0.1), "CASE WHEN returns IS NOT NULL THEN least(returns, 0.1::DOUBLE) END")
cells("e12_max", lambda: E.at_least(c("returns"), -0.1), "CASE WHEN returns IS NOT NULL THEN greatest(returns, (-0.1)::DOUBLE) END")
# --- across symbols -----------------------------------------------------------------------------------------------------


def rank_sql(x: str, by: str = "dt") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2::DOUBLE) / count({x}) OVER (PARTITION BY {by}) END"


cells("c1_rank_close", lambda: X.rank(c("close")), rank_sql("close"))
cells("c1_rank_volume", lambda: X.rank(c("volume")), rank_sql("volume"))
cells("c2_zscore_returns", lambda: X.zscore(c("returns")), "(returns - avg(returns) OVER (PARTITION BY dt)) / nullif(stddev_samp(returns) OVER (PARTITION BY dt), 0)")
cells("c3_demean_returns", lambda: X.demean(c("returns")), "returns - avg(returns) OVER (PARTITION BY dt)")
cells("c4_scale_returns", lambda: X.scale(c("returns"), 2.0), "returns / nullif(sum(abs(returns)) OVER (PARTITION BY dt), 0) * 2::DOUBLE")
# --- along time ---------------------------------------------------------------------------------------------------------
lag_sql = lambda x, d: f"lag({x}, {d}) OVER (PARTITION BY symbol ORDER BY dt)"
cells("t1_delay_w4", lambda: T.delay(c("close"), 4), lag_sql("close", 4))
cells("t2_delta_w4", lambda: T.delta(c("close"), 4), f"close - {lag_sql('close', 4)}")
cells("t3_ts_mean_w8", lambda: T.ts_mean(c("returns"), 8), full_sql(f"avg(returns) {frame_sql(8)}", 8, "returns"))
cells("t4_ts_std_w8", lambda: T.ts_std(c("returns"), 8), full_sql(f"stddev_samp(returns) {frame_sql(8)}", 8, "returns"))
cells("t5_ts_sum_w8", lambda: T.ts_sum(c("volume"), 8), full_sql(f"sum(volume) {frame_sql(8)}", 8, "volume"))
cells("t6_ts_min_w8", lambda: T.ts_min(c("low"), 8), full_sql(f"min(low) {frame_sql(8)}", 8, "low"))
cells("t7_ts_max_w8", lambda: T.ts_max(c("high"), 8), full_sql(f"max(high) {frame_sql(8)}", 8, "high"))
QUERIES["t8_ts_rank_w8"] = lambda spark, sf_dir: brand_panel(spark, sf_dir).select("symbol", "dt", near(T.ts_rank(c("close"), 8)).alias("value"))
SQL["t8_ts_rank_w8"] = f"WITH {PANEL}, l AS (SELECT symbol, dt, close AS x, list(close) {frame_sql(8)} AS w, count(close) {frame_sql(8)} AS n FROM panel)\nSELECT symbol, dt, CASE WHEN n = 8 THEN round(len([v FOR v IN w IF v <= x]) / 8::DOUBLE, {DIGITS}) END AS value FROM l"
cells("t9_ts_corr_w8", lambda: T.ts_corr(c("returns"), c("volume"), 8), full_sql(f"covar_samp(returns, volume) {frame_sql(8)} / nullif(stddev_samp(returns) {frame_sql(8)} * stddev_samp(volume) {frame_sql(8)}, 0)", 8, "returns", "volume"))
cells("t10_ts_cov_w8", lambda: T.ts_cov(c("returns"), c("volume"), 8), full_sql(f"covar_samp(returns, volume) {frame_sql(8)}", 8, "returns", "volume"))
decay_sql = lambda x, d: full_sql("(" + " + ".join(f"{d - k} * {x if not k else lag_sql(x, k)}" for k in range(d)) + f") / {d * (d + 1) / 2}::DOUBLE", d, x)
cells("t11_decay_linear_w8", lambda: T.decay_linear(c("returns"), 8), decay_sql("returns", 8))
cells("t11_decay_linear_w20", lambda: T.decay_linear(c("returns"), 20), decay_sql("returns", 20))
QUERIES["t11_decay_linear_w252"] = lambda spark, sf_dir: rounded(R.linear_decay(brand_panel(spark, sf_dir), "value", c("returns"), 252).select("symbol", "dt", "value"))
SQL["t11_decay_linear_w252"] = f"WITH {PANEL}\nSELECT symbol, dt, round({decay_sql('returns', 252)}, {DIGITS}) AS value FROM panel"
cells("t12_product_w5", lambda: T.product(c("returns") + 1, 5), full_sql(f"product(1 + returns) {frame_sql(5)}", 5, "returns"))
# --- admitted shapes ----------------------------------------------------------------------------------------------------
mean_sql = lambda x, d: full_sql(f"avg({x}) {frame_sql(d)}", d, x)
std_sql = lambda x, d: full_sql(f"stddev_samp({x}) {frame_sql(d)}", d, x)
SHAPES = {
    "k1_volume": "volume", "k2_range": "high - low", "k3_gap_mean": f"close - {mean_sql('close', 8)}", "k3_reversal": f"-(close - {lag_sql('close', 4)})",
    "k4_mean_gap": f"{mean_sql('close', 4)} - {mean_sql('close', 16)}", "k5_deviation": f"-((close - {mean_sql('close', 8)}) / nullif({std_sql('close', 8)}, 0))",
    "k6_location": f"{mean_sql('returns', 8)} / nullif({std_sql('returns', 8)}, 0)", "k7_range_ratio": "(high - low) / nullif(close, 0)",
    "k8_corr": full_sql(f"covar_samp(close, volume) {frame_sql(8)} / nullif(stddev_samp(close) {frame_sql(8)} * stddev_samp(volume) {frame_sql(8)}, 0)", 8, "close", "volume"), "k9_vwap_spread": "close - vwap",
}
for row in CATALOG:
    final = "(round(x, 9) - avg(round(x, 9)) OVER (PARTITION BY dt)) / nullif(stddev_samp(round(x, 9)) OVER (PARTITION BY dt), 0)" if row[6] == "zscore" else rank_sql("round(x, 9)")
    QUERIES[row[0]] = lambda spark, sf_dir, row=row: rounded(stable_signals(brand_panel(spark, sf_dir), [row]).select("symbol", "dt", "value"))
    SQL[row[0]] = f"WITH {PANEL}, raw AS (SELECT symbol, dt, {SHAPES[row[0]]} AS x FROM panel)\nSELECT symbol, dt, round({final}, {DIGITS}) AS value FROM raw"


def stable_signals(panel: DataFrame, rows=CATALOG, faults: bool = False) -> DataFrame:
    """Signals ranked on raw values of nine digits, so that sums in another order don't break ties otherwise."""
    return signals(panel, rows, faults, adjust=lambda x: near(x, 9))


# --- scans, sources, panel ----------------------------------------------------------------------------------------------
@query("s2_scan", "SELECT p_brand AS symbol, count(*) AS n, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#55') AND l_shipdate >= '1994-01-01' AND l_shipdate < '1996-01-01' AND l_quantity > 0 GROUP BY ALL")
def s2_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and dates, the end day whole."""
    return S.scan(brand_trades(spark, sf_dir), ["Brand#11", "Brand#23", "Brand#55"], "1994-01-01", "1995-12-31").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("s4_all_symbols", "SELECT DISTINCT p_brand AS symbol FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 0")
def s4_all_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.all_symbols(brand_trades(spark, sf_dir))


@query("s5_clean_bars", """WITH raw AS (SELECT o_orderkey AS k, o_custkey % 50 AS s, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, o_totalprice AS px FROM orders WHERE o_orderkey % 7 <> 0)
SELECT 'C' || s AS symbol, ts, arg_min(px, k) AS open, arg_min(px, k) AS close FROM raw GROUP BY ALL""")
def s5_clean_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raw text download with mixed times, junk numbers and repeats."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    price = F.when(c("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(c("o_totalprice").cast("string"))
    date = F.when(c("o_orderkey") % 3 == 0, F.concat(day, F.lit(" 00:00:00+00:00"))).when(c("o_orderkey") % 3 == 1, F.concat(day, F.lit(" 00:00:00"))).otherwise(day)
    raw = o.select(date.alias("Date"), F.concat(F.lit("C"), c("o_custkey") % 50).alias("Symbol"), *(price.alias(n) for n in ("Open", "High", "Low", "Close")), F.lit("1").alias("Volume"), c("o_orderkey").alias("row"))
    return S.clean(raw).select("symbol", "ts", "open", "close")


@query("s6_coverage_report", f"WITH {bars_sql()}, b AS (SELECT symbol, count(*) AS n, min(dt) AS lo, max(dt) AS hi FROM bars GROUP BY symbol) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_symbols, min(lo) AS first_dt, max(hi) AS last_dt, min(n) AS min_rows, median(n) AS median_rows, max(n) AS max_rows FROM b")
def s6_coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coverage_report(brand_bars(spark, sf_dir))


@query("s7_wide_to_long", f"WITH {bars_sql('month')} SELECT symbol, dt, round(open, 4) AS open, round(close, 4) AS close FROM bars")
def s7_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide columns of all brands and back."""
    bars = brand_bars(spark, sf_dir, "month")
    names = [r.symbol for r in S.all_symbols(bars).collect()]  # a wide table has a column a symbol
    long = P.from_wide(P.wide(bars, names).withColumnRenamed("dt", "Datetime"))
    return long.where("open IS NOT NULL").select("symbol", "dt", near(c("open"), 4).alias("open"), near(c("close"), 4).alias("close"))


@query("s8_profiled_names", "SELECT p_partkey, 'Data_' || p_brand || '_' || CASE WHEN p_size % 2 = 0 THEN 'US' ELSE 'XX' END || '_D1.parquet' AS name, p_brand <> 'Brand#11' OR p_size % 2 = 0 AS loadable FROM part")
def s8_profiled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Data_"), "p_brand", F.lit("_"), F.when(c("p_size") % 2 == 0, "US").otherwise("XX"), F.lit("_D1.parquet")).alias("name"))
    return S.profiled_names(names, ["Brand#11"], ["US", "EU"]).select("p_partkey", "name", "loadable")


#: Orders that one task sorts and writes.
PART_ROWS = 1_000_000


@query("s9_discover", "SELECT DISTINCT 'Data_' || o_orderpriority[1:1] || '_' || CASE WHEN o_orderpriority < '3' THEN 'US' ELSE 'XX' END || '_D1.parquet' AS name FROM orders WHERE o_orderpriority IS NOT NULL AND (o_orderpriority[1:1] <> '5' OR o_orderpriority < '3')")
def s9_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each priority of the orders, in a folder and one below; type 5 needs a known region.

    A file is a folder of parts, as Spark writes it, so a task writes PART_ROWS orders or so, however many there are.
    """
    folder = shared_dir(spark)
    kind = c("o_orderpriority").substr(1, 1)
    name = F.concat(F.lit("Data_"), kind, F.lit("_"), F.when(c("o_orderpriority") < "3", "US").otherwise("XX"), F.lit("_D1.parquet"))
    everything = table(spark, sf_dir, "orders")
    tasks = max(1, -(-everything.count() // PART_ROWS))
    orders = everything.where("o_orderpriority IS NOT NULL").select(name.alias("name"), "o_orderkey")
    orders.repartition(tasks, "o_orderkey").write.partitionBy("name").parquet(f"{folder}/raw")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for place in ("", "below/"):
        files.mkdirs(path(f"{folder}/found/{place}"))
    written = sorted(n for s in files.listStatus(path(f"{folder}/raw")) if (n := s.getPath().getName()).startswith("name="))  # a folder a priority
    for i, part in enumerate(written):
        files.rename(path(f"{folder}/raw/{part}"), path(f"{folder}/found/{'below/' * (i % 2)}{part.removeprefix('name=')}"))
    return S.discover(spark, f"{folder}/found", ["5"], ["US"]).select("name")


@query("p2_usable_symbols", "SELECT DISTINCT p_brand AS symbol FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 0 AND l_extendedprice IS NOT NULL")
def p2_usable_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.usable_symbols(brand_bars(spark, sf_dir))


@query("p3_missing_symbols", "SELECT DISTINCT p_type AS symbol FROM part WHERE p_type NOT IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey)")
def p3_missing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested names are brands and, wrongly, part types."""
    part = table(spark, sf_dir, "part")
    asked = part.select(c("p_brand").alias("symbol")).union(part.select("p_type")).distinct()
    return P.missing_symbols(asked, brand_bars(spark, sf_dir), allow_missing=True)


def digits_of(field: str) -> int:
    return 6 if field == "returns" else 4


@query("p5_panel", f"WITH {PANEL} SELECT symbol, dt, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume, round(vwap, 4) AS vwap, round(typical_price, 4) AS typical_price, round(returns, 6) AS returns, 'lineitem(vwap=source)' AS source FROM panel")
def p5_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel with derived fields and provenance."""
    return brand_panel(spark, sf_dir).select("symbol", "dt", *(near(c(n), digits_of(n)).alias(n) if n != "volume" else c(n) for n in FIELDS), "source")


@query("p8_slice", f"WITH {PANEL} SELECT symbol, dt, volume FROM panel WHERE dt BETWEEN '1995-01-02' AND '1996-01-01'")
def p8_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.between(brand_panel(spark, sf_dir), "1995-01-02", "1996-01-01").select("symbol", "dt", "volume")


def digest_sql(columns: dict[str, str], source: str, by: str = "", digits: int = 6) -> str:
    """The content hash of panel.fingerprint; `columns` are SQL expressions and their kinds, double or text."""
    texts = [f"CASE WHEN {x} IS NULL THEN '-' WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END ELSE round_even({x} * 1e{digits}::DOUBLE, 0)::HUGEINT::VARCHAR END" if kind == "double" else f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')" for x, kind in columns.items()]
    word = lambda at: f"coalesce(sum(('0x' || substr(h, {at}, 15))::BIGINT), 0)::VARCHAR"
    keys = f"{by}, " if by else ""
    return f"""SELECT *, sha256(concat_ws('|', rows, total1, total2)) AS version FROM (SELECT {keys}count(*) AS rows, {word(1)} AS total1, {word(16)} AS total2 FROM (SELECT {keys}sha256(concat_ws('|', {", ".join(texts)})) AS h FROM {source}) {f"GROUP BY {by}" if by else ""})"""


@query("p9_fingerprint", f"WITH {PANEL}, shown AS (SELECT symbol, dt, 'lineitem(vwap=source)' AS source, {', '.join(f'round({n}, {digits_of(n)}) AS {n}' for n in FIELDS)} FROM panel) {digest_sql({'symbol': 'text', 'dt': 'text', **dict.fromkeys(FIELDS, 'double'), 'source': 'text'}, 'shown')}")
def p9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fingerprint(p5_panel(spark, sf_dir).withColumn("volume", near(c("volume"), 4)), ["symbol", "dt", *FIELDS, "source"], digits=6)


for unit in ("day", "week", "month"):
    QUERIES[f"p10_bars_{unit}"] = lambda spark, sf_dir, unit=unit: rounded(brand_bars(spark, sf_dir, unit), 4).drop(*(["vwap"] if unit == "day" else []))
    SQL[f"p10_bars_{unit}"] = f"WITH {bars_sql(unit)} SELECT symbol, dt, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume{'' if unit == 'day' else ', round(vwap, 4) AS vwap'} FROM bars"
QUERIES["p10_bars_events"] = lambda spark, sf_dir: rounded(event_bars(spark, sf_dir), 4)
SQL["p10_bars_events"] = "SELECT event_type AS symbol, CAST(ts AS DATE) AS dt, round(arg_min(value, ts), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(arg_max(value, ts), 4) AS close, count(value)::DOUBLE AS volume, round(avg(value), 4) AS vwap FROM events GROUP BY ALL"


@query("p11_wall_clock", "SELECT event_id, date_trunc('second', ts) AS wall FROM events")
def p11_wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(c("event_id") % 3 == 0, "Z").when(c("event_id") % 3 == 1, "+02:00").otherwise("-0500")
    return table(spark, sf_dir, "events").select("event_id", P.wall_clock(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)).alias("wall"))


@query("p14_axis_faults", f"WITH {bars_sql()} SELECT symbol, dt, count(*) AS n FROM (SELECT symbol, dt FROM bars UNION ALL SELECT symbol, dt FROM bars WHERE symbol = 'Brand#11') GROUP BY ALL HAVING count(*) > 1")
def p14_axis_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_bars(spark, sf_dir)
    return P.axis_faults(bars.union(bars.where("symbol = 'Brand#11'")))


BUSINESS = "SELECT CAST(d AS DATE) AS dt FROM (SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders)::TIMESTAMP, (SELECT max(o_orderdate)::DATE FROM orders)::TIMESTAMP, INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6"


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business days over the span of the orders."""
    span = table(spark, sf_dir, "orders").agg(F.min(c("o_orderdate").cast("date")).alias("a"), F.max(c("o_orderdate").cast("date")).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("dt")).where(F.weekday("dt") < 5)


@query("p15_business_days", BUSINESS)
def p15_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_days(spark, sf_dir)


@query("p16_session_bounds", f"WITH d AS ({BUSINESS}) SELECT min(dt) AS first_session, max(dt) AS last_session FROM d WHERE dt BETWEEN '1995-01-01' AND '1995-12-31' AND dt NOT IN (SELECT o_orderdate::DATE FROM orders WHERE month(o_orderdate) = 1 AND day(o_orderdate) = 2)")
def p16_session_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' 2nd of January are the holidays."""
    o = table(spark, sf_dir, "orders").where("month(o_orderdate) = 1 AND day(o_orderdate) = 2").select(c("o_orderdate").cast("date").alias("dt")).distinct()
    return P.session_bounds(order_days(spark, sf_dir).join(F.broadcast(o), "dt", "left_anti"), "1995-01-01", "1995-12-31")


@query("p17_source_calendar", "SELECT CASE WHEN count(DISTINCT c) = 1 AND bool_and(c IS NOT NULL) THEN min(c) END AS calendar, count(DISTINCT c) AS n, count(*) FILTER (c IS NULL) AS unknown FROM (SELECT DISTINCT p_brand, 'XNYS' AS c FROM part)")
def p17_source_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = spark.createDataFrame([("-", "XNYS"), ("L", "XLON")], "suffix string, calendar string")
    return P.source_calendar(table(spark, sf_dir, "part").select(c("p_brand").alias("symbol")).distinct(), suffixes)


@query("p18_coverage", f"WITH {bars_sql()} SELECT min(dt) AS first_dt, max(dt) AS last_dt, min(dt) <= '1992-06-01' AS covers_start, max(dt) >= '1999-06-01' AS covers_end FROM bars")
def p18_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coverage(brand_bars(spark, sf_dir), "1992-06-01", "1999-06-01")


@query("p19_symbol_list", "SELECT DISTINCT trim(s) AS symbol FROM (SELECT unnest(string_split(p_name, ' ')) AS s FROM part) WHERE trim(s) <> ''")
def p19_symbol_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.symbol_list(table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit(" , ")).alias("names")), "names")


# --- validity -----------------------------------------------------------------------------------------------------------
@query("m5_node_report", f"WITH {PANEL} SELECT node, count(*) AS cells, count(*) FILTER (value IS NULL) AS invalid_cells, count(*) FILTER (isnan(value) OR isinf(value)) AS faults FROM (SELECT 'close' AS node, close AS value FROM panel UNION ALL SELECT 'returns', returns FROM panel UNION ALL SELECT 'mean', {mean_sql('returns', 8)} FROM panel UNION ALL SELECT 'overflow', CASE WHEN volume IS NOT NULL THEN 'infinity'::DOUBLE END FROM panel) GROUP BY node")
def m5_node_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2-M5: masks and faults by node; the last node overflows."""
    df = brand_panel(spark, sf_dir).withColumns({"mean": T.ts_mean(c("returns"), 8), "overflow": F.exp(c("volume") * 0 + 1e6)})
    return Q.node_report(df, ["close", "returns", "mean", "overflow"])


@query("m6_admission", f"""WITH {PANEL}, s AS (SELECT dt, 'fine' AS candidate_id, returns AS value FROM panel UNION ALL SELECT dt, 'flat', CASE WHEN close IS NOT NULL THEN 1::DOUBLE END FROM panel UNION ALL SELECT dt, 'late', CASE WHEN dt > '1997-01-01' THEN close END FROM panel UNION ALL SELECT dt, 'overflow', CASE WHEN close IS NOT NULL THEN 'infinity'::DOUBLE END FROM panel)
SELECT candidate_id, count(value) AS valid_cells, count(*) FILTER (isinf(value) OR isnan(value)) AS faults, CASE WHEN count(*) FILTER (isinf(value) OR isnan(value)) > 0 THEN 'NUMERICAL_NONFINITE' WHEN count(value) = 0 THEN 'VALID_COVERAGE' WHEN min(value) = max(value) THEN 'DEGENERATE_SIGNAL' ELSE 'ADMITTED' END AS outcome FROM s WHERE dt BETWEEN '1993-01-01' AND '1996-12-31' GROUP BY candidate_id""")
def m6_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M3, M6, M7."""
    df = Q.truncated(brand_panel(spark, sf_dir), "1996-12-31")
    inf = F.when(c("close").isNotNull(), F.lit(float("inf")))
    wide = df.select("dt", "symbol", c("returns").alias("fine"), F.when(c("close").isNotNull(), F.lit(1.0)).alias("flat"), F.when(c("dt") > "1997-01-01", c("close")).alias("late"), inf.alias("overflow"))
    return Q.admission(wide.unpivot(["dt", "symbol"], ["fine", "flat", "late", "overflow"], "candidate_id", "value"), "1993-01-01", "1996-12-31")


SIGNALS = f""", raw0 AS (SELECT symbol, dt, {', '.join(f'round({sql}, 9) AS {name}' for name, sql in SHAPES.items())} FROM panel),
long AS (UNPIVOT raw0 ON {', '.join(SHAPES)} INTO NAME candidate_id VALUE x), raw AS (SELECT k.candidate_id, p.symbol, p.dt, l.x FROM panel p CROSS JOIN (SELECT unnest([{', '.join(repr(n) for n in SHAPES)}]) AS candidate_id) k LEFT JOIN long l ON l.symbol = p.symbol AND l.dt = p.dt AND l.candidate_id = k.candidate_id),
signal AS (SELECT candidate_id, symbol, dt, CASE WHEN candidate_id = 'k3_gap_mean' THEN (x - avg(x) OVER (PARTITION BY candidate_id, dt)) / nullif(stddev_samp(x) OVER (PARTITION BY candidate_id, dt), 0) ELSE {rank_sql('x', 'candidate_id, dt')} END AS value FROM raw)"""


@query("m8_signal_hash", f"WITH {PANEL}{SIGNALS}, shown AS (SELECT candidate_id, dt, symbol, round(value, 6) AS value FROM signal) {digest_sql({'dt': 'text', 'symbol': 'text', 'value': 'double'}, 'shown', 'candidate_id', 9)}")
def m8_signal_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.signal_hash(rounded(stable_signals(brand_panel(spark, sf_dir))))


#: SQL of the inner nodes of each shape, beside its inputs and its value.
NODES = {
    "k3_gap_mean": [mean_sql("close", 8)], "k4_mean_gap": [mean_sql("close", 4), mean_sql("close", 16)], "k5_deviation": [mean_sql("close", 8), std_sql("close", 8)],
    "k6_location": [mean_sql("returns", 8), std_sql("returns", 8)], "k7_range_ratio": ["high - low", "close"],
    "k8_corr": [full_sql(f"stddev_samp({x}) {frame_sql(8)}", 8, "close", "volume") for x in ("close", "volume")] + [full_sql(f"covar_samp(close, volume) {frame_sql(8)}", 8, "close", "volume")],
}
odd_sql = lambda x: f"coalesce(isnan({x}) OR isinf({x}), false)"


def faults_sql(names: list[str], source: str = "panel") -> str:
    """CTE fault_cells: (candidate_id, symbol, dt, fault), a cell's inputs, inner nodes, raw value and the dispersion of its date."""
    inputs = {r[0]: [f for f in r[2:4] if f] for r in CATALOG}
    one = lambda n: f"SELECT '{n}' AS candidate_id, symbol, dt, {' OR '.join(map(odd_sql, [*inputs[n], *NODES.get(n, []), SHAPES[n]]))} AS low, {SHAPES[n]} AS x FROM {source}"
    spread = "CASE WHEN candidate_id = 'k3_gap_mean' THEN stddev_samp(x) OVER (PARTITION BY candidate_id, dt) END"
    return f"low_cells AS ({' UNION ALL '.join(map(one, names))}), fault_cells AS (SELECT candidate_id, symbol, dt, low OR {odd_sql(spread)} AS fault FROM low_cells)"


FAULTY = "count(*) FILTER (isinf(value) OR isnan(value))"
OUTCOME = f"CASE WHEN {FAULTY} > 0 THEN 'NUMERICAL_NONFINITE' WHEN count(value) = 0 THEN 'VALID_COVERAGE' WHEN min(value) = max(value) THEN 'DEGENERATE_SIGNAL' ELSE 'ADMITTED' END"
ORDER_OF = f"list_position([{', '.join(repr(r[0]) for r in CATALOG)}], candidate_id)"


@query("g4_dead_ends", f"WITH {PANEL}{SIGNALS} SELECT candidate_id, count(value) AS valid_cells, {FAULTY} AS faults, {OUTCOME} AS outcome, ({ORDER_OF} - 1)::INT AS candidate FROM signal WHERE dt BETWEEN '1993-01-01' AND '1996-12-31' GROUP BY candidate_id")
def g4_dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.admissions(brand_panel(spark, sf_dir), "1993-01-01", "1996-12-31").join(catalog(spark).select("candidate_id", "candidate"), "candidate_id")


@query("g4_spoilt_input", f"""WITH {PANEL}{SIGNALS}, plain AS (SELECT candidate_id, {OUTCOME} AS outcome FROM signal WHERE dt BETWEEN '1993-01-01' AND '1996-12-31' GROUP BY candidate_id)
SELECT candidate_id, CASE WHEN candidate_id IN ({', '.join(repr(r[0]) for r in CATALOG if 'volume' in r[2:4])}) THEN 'NUMERICAL_NONFINITE' ELSE outcome END AS outcome FROM plain""")
def g4_spoilt_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date's volumes are infinite: what reads them is rejected, though a rank of them is finite."""
    panel = brand_panel(spark, sf_dir)
    first = panel.where("dt >= '1993-01-01' AND volume IS NOT NULL").agg(F.min("dt").alias("spoilt"))
    spoilt = panel.join(F.broadcast(first), c("dt") == c("spoilt"), "left").withColumn("volume", F.when(c("spoilt").isNotNull() & c("volume").isNotNull(), F.lit(float("inf"))).otherwise(c("volume")))
    return G.admissions(spoilt.drop("spoilt"), "1993-01-01", "1996-12-31").select("candidate_id", "outcome")


HUGE = [r[0] for r in CATALOG]


@query("m4_dispersion_faults", f"""WITH {PANEL.replace('panel AS (SELECT *', 'small AS (SELECT *')}, panel AS (SELECT * REPLACE (close * 1e200::DOUBLE AS close, vwap * 1e200::DOUBLE AS vwap) FROM small){SIGNALS}, {faults_sql(HUGE)}
SELECT candidate_id, count(value) AS valid_cells, count(*) FILTER (fault) AS faults, CASE WHEN count(*) FILTER (fault) > 0 THEN 'NUMERICAL_NONFINITE' WHEN count(value) = 0 THEN 'VALID_COVERAGE' WHEN min(value) = max(value) THEN 'DEGENERATE_SIGNAL' ELSE 'ADMITTED' END AS outcome
FROM signal JOIN fault_cells USING (candidate_id, symbol, dt) WHERE dt BETWEEN '1993-01-01' AND '1996-12-31' GROUP BY candidate_id""")
def m4_dispersion_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M4: closes so large that their squares overflow. Their means and ranks are finite, their deviations aren't."""
    huge = brand_panel(spark, sf_dir).withColumns({n: c(n) * 1e200 for n in ("close", "vwap")})
    return Q.admission(stable_signals(Q.truncated(huge, "1996-12-31"), faults=True), "1993-01-01", "1996-12-31")


# --- writing and reading back -------------------------------------------------------------------------------------------
@query("s1_load_bars", f"WITH {bars_sql()} SELECT symbol, dt::TIMESTAMP AS ts, round(open, 6) AS open, round(close, 6) AS close, volume, round(vwap, 6) AS vwap FROM bars WHERE symbol IN ('Brand#11', 'Brand#23') AND dt BETWEEN '1994-01-01' AND '1996-12-31'")
def s1_load_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written in the long layout and loaded by source, symbols and dates."""
    path = shared_dir(spark)
    long = {"Datetime": c("dt").cast("timestamp_ntz"), "Symbol": c("symbol"), "Open": c("open"), "High": c("high"), "Low": c("low"), "Close": c("close"), "Volume": c("volume"), "Vwap": c("vwap")}
    brand_bars(spark, sf_dir).select(*(x.alias(n) for n, x in long.items())).write.parquet(path)
    return rounded(S.load_bars(spark, "parquet", [path], ["Brand#11", "Brand#23"], "1994-01-01", "1996-12-31").select("symbol", "ts", "open", "close", "volume", "vwap"))


@query("s10_ledger", """SELECT 'good' AS kind, 'run-' || (o_custkey % 3) AS run_id, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY ALL
UNION ALL SELECT 'corrupt', NULL, count(*), NULL FROM part""")
def s10_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends and torn lines; good rows and corrupt lines come back apart."""
    path = shared_dir(spark)
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("run-"), c("o_custkey") % 3).alias("run_id"), c("o_orderdate").cast("date").cast("string").alias("research_date"), c("o_orderpriority").alias("formula"), c("o_orderkey").alias("line"))
    for part in (0, 1):
        S.append_ledger(o.where(c("line") % 2 == part), path)
    table(spark, sf_dir, "part").select(F.concat(F.lit('{"research_date": '), "p_type")).write.mode("append").text(f"{path}/run_id=run-0")
    good, corrupt = S.read_ledger(spark, path, o.drop("run_id").schema)
    return good.groupBy(F.lit("good").alias("kind"), "run_id").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last")).unionByName(corrupt.agg(F.count(F.lit(1)).alias("n")).select(F.lit("corrupt").alias("kind"), F.lit(None).cast("string").alias("run_id"), "n", F.lit(None).cast("long").alias("last")))


@query("s12_manifest", "SELECT count(*) AS n_orders, max(o_orderdate)::DATE::VARCHAR AS last_date, 'second' AS run_name FROM orders")
def s12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest is replaced whole."""
    path, o = shared_dir(spark), table(spark, sf_dir, "orders")
    for name in ("first", "second"):
        row = o.agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderdate").cast("date").cast("string").alias("last_date")).withColumn("run_name", F.lit(name))
        S.write_manifest(row, path)
    return S.read_manifest(spark, path, row.schema)


@query("s13_entries", "SELECT o_orderpriority AS run_id, count(*) AS n, min(o_orderdate)::DATE::VARCHAR AS first_archived FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def s13_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal entries, a file each."""
    path = shared_dir(spark)
    e = table(spark, sf_dir, "orders").groupBy(c("o_orderpriority").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").cast("date").cast("string").alias("first_archived"))
    e.withColumn("entry", F.xxhash64("run_id")).write.partitionBy("entry").json(path)
    return S.load_entries(spark, path, e.schema).select("run_id", "n", "first_archived")


@query("s14_truncate_trace", "SELECT 'r' || user_id AS run_id, event_id AS seq, event_type AS step FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3")
def s14_truncate_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces of users."""
    return S.truncate_trace(table(spark, sf_dir, "events").select(F.concat(F.lit("r"), "user_id").alias("run_id"), c("event_id").alias("seq"), c("event_type").alias("step")), 3)


@query("s15_register_signal", f"WITH {PANEL}{SIGNALS} SELECT symbol, dt, round(value, 6) AS value, 'feature_1' AS feature_id FROM signal WHERE candidate_id = 'k2_range' AND dt >= '1995-01-01'")
def s15_register_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = brand_panel(spark, sf_dir)
    signal = stable_signals(panel).where("candidate_id = 'k2_range'").select("symbol", "dt", "value")
    return rounded(S.register_signal(signal, panel.where("dt >= '1995-01-01'").select("dt").distinct(), shared_dir(spark), "feature_1").select("symbol", "dt", "value", "feature_id"))


@query("p4_request_order", f"WITH {bars_sql()}, asked AS (SELECT p_brand AS symbol, row_number() OVER (ORDER BY count(*) DESC, p_brand)::INT AS symbol_ord FROM part GROUP BY p_brand) SELECT symbol_ord, symbol, dt, round(close, 6) AS close FROM bars JOIN asked USING (symbol)")
def p4_request_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands are asked for by their number of parts."""
    counts = table(spark, sf_dir, "part").groupBy(c("p_brand").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    asked = counts.select("symbol", F.row_number().over(Window.orderBy(c("n").desc(), "symbol")).alias("symbol_ord"))  # a row a brand
    return rounded(P.in_request_order(brand_bars(spark, sf_dir), asked).select("symbol_ord", "symbol", "dt", "close"))


@query("m9_genuine_vwap", f"WITH {PANEL} SELECT symbol, count(vwap) AS n, round(max(vwap), 6) AS high FROM panel GROUP BY symbol")
def m9_genuine_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.require_genuine_vwap(brand_panel(spark, sf_dir)).groupBy("symbol").agg(F.count("vwap").alias("n"), F.max("vwap").alias("high")))


@query("j7_context", """SELECT sha256('{"o_orderpriority":' || coalesce('"' || o_orderpriority || '"', 'null') || ',"year":' || year(o_orderdate) || '}') AS context, count(*) AS n FROM orders GROUP BY 1""")
def j7_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and year as scoring contexts."""
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return o.groupBy(J.evidence_context(["o_orderpriority", "year"]).alias("context")).agg(F.count(F.lit(1)).alias("n"))


@query("j13_stale", "SELECT count(*) FILTER (o_orderdate < '1998-01-01') AS old_rows, count(*) AS new_rows, count(*) FILTER (o_orderdate >= '1998-01-01') > 0 AS stale, false AS stale_again FROM orders")
def j13_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of all orders against that of the years before 1998, and against itself."""
    o = table(spark, sf_dir, "orders")
    old, new = (J.corpus_fingerprint(df, ["o_orderkey", "o_totalprice"]) for df in (o.where("o_orderdate < '1998-01-01'"), o))
    both = old.select(c("rows").alias("old_rows")).crossJoin(new.select(c("rows").alias("new_rows")))  # one row each
    return both.crossJoin(J.stale(old, new)).crossJoin(J.stale(new, new).select(c("stale").alias("stale_again")))


# --- portfolio and replay -----------------------------------------------------------------------------------------------
ONE = [r for r in CATALOG if r[0] == "k3_reversal"]
SIGNAL = f"""{SETTLED}, raw AS (SELECT symbol, dt, round(-(close - {lag_sql('close', 4)}), 9) AS x FROM panel), signal AS (SELECT symbol, dt, {rank_sql('x')} AS value FROM raw)"""
CENTRED = "centred AS (SELECT symbol, dt, value - avg(value) OVER (PARTITION BY dt) AS z FROM signal)"
BOOK = f"{SIGNAL}, {CENTRED}, book AS (SELECT symbol, dt, z / nullif(sum(abs(z)) OVER (PARTITION BY dt), 0) AS s FROM centred)"
WEIGHTS = f"{BOOK}, weights AS (SELECT symbol, dt, coalesce(lag(s) OVER (PARTITION BY symbol ORDER BY dt), 0) AS w FROM book)"


def replay_sql(rate: float, passes: int) -> str:
    """Panel with open = previous close, so nothing happens over night."""
    out = [f"{WEIGHTS}, p0 AS (SELECT w.symbol, w.dt, w.w, coalesce(p.close / p.open - 1, 0) AS x, 0::DOUBLE AS c, sum(w.w * coalesce(p.close / p.open - 1, 0)) OVER (PARTITION BY w.dt) AS intra FROM weights w JOIN panel p USING (symbol, dt))"]
    for i in range(passes):
        out.append(f"q{i} AS (SELECT *, w * (1 + x) / (1 - c + intra) AS carried FROM p{i}), r{i} AS (SELECT *, coalesce(lag(carried) OVER (PARTITION BY symbol ORDER BY dt), 0) AS held FROM q{i}), p{i + 1} AS (SELECT symbol, dt, w, x, intra, sum(abs(w - held)) OVER (PARTITION BY dt) AS turnover, sum(abs(w - held)) OVER (PARTITION BY dt) * {rate!r}::DOUBLE AS c FROM r{i})")
    return ", ".join(out) + f", daily AS (SELECT dt, max(intra) - max(c) AS ret, max(turnover) AS turnover, sum(abs(w)) AS gross FROM p{passes} GROUP BY dt)"


REPLAYED = replay_sql(CONFIG.cost_bps / 1e4, 2)


def one_signal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = brand_settlement(spark, sf_dir)
    return stable_signals(panel, ONE), panel


@query("b1_strength", f"WITH {BOOK} SELECT symbol, dt, round(s, 6) AS s FROM book")
def b1_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.strengths(one_signal(spark, sf_dir)[0])).select("symbol", "dt", "s")


@query("b2_capped", f"WITH {BOOK}, more AS (SELECT symbol, dt, 3 * s AS s FROM book) SELECT symbol, dt, round(s * least(1, 2 / nullif(sum(abs(s)) OVER (PARTITION BY dt), 0)), 6) AS s FROM more")
def b2_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.capped(B.strengths(one_signal(spark, sf_dir)[0], 3.0), 2.0)).select("symbol", "dt", "s")


SIDES = f"{BOOK}, placed AS (SELECT *, row_number() OVER (PARTITION BY dt, sign(s) ORDER BY round(abs(s), 9) DESC NULLS LAST, symbol) AS place, count(*) FILTER (s <> 0) OVER (PARTITION BY dt, sign(s)) AS n FROM book)"


def selected(spark: SparkSession, sf_dir: str, config: Config) -> DataFrame:
    book = B.strengths(one_signal(spark, sf_dir)[0]).withColumn("s", near(c("s"), 9))
    return rounded(B.select_names(book, config)).select("symbol", "dt", "s")


QUERIES["b3_top_k"] = lambda spark, sf_dir: selected(spark, sf_dir, Config(selection="top_k", top_k=3))
SQL["b3_top_k"] = f"WITH {SIDES}, kept AS (SELECT symbol, dt, CASE WHEN place <= 3 AND s <> 0 THEN s END AS s FROM placed) SELECT symbol, dt, round(s / nullif(sum(abs(s)) OVER (PARTITION BY dt), 0), 6) AS s FROM kept"
QUERIES["b3_top_q"] = lambda spark, sf_dir: selected(spark, sf_dir, Config(selection="top_q", top_q=0.2))
SQL["b3_top_q"] = f"WITH {SIDES}, kept AS (SELECT symbol, dt, CASE WHEN place <= ceil(0.2::DOUBLE * n) AND s <> 0 THEN s END AS s FROM placed) SELECT symbol, dt, round(s / nullif(sum(abs(s)) OVER (PARTITION BY dt), 0), 6) AS s FROM kept"


@query("b5_hold_rebalance", f"WITH {BOOK}, n AS (SELECT *, dense_rank() OVER (ORDER BY dt) - 1 AS bar FROM book), e AS (SELECT symbol, dt, CASE WHEN bar % 2 = 0 THEN s END AS s FROM n), h AS (SELECT symbol, dt, sum(s) {frame_sql(4)} AS s FROM e) SELECT symbol, dt, round(s / nullif(sum(abs(s)) OVER (PARTITION BY dt), 0), 6) AS s FROM h")
def b5_hold_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries on every second bar, held four bars."""
    return rounded(B.entries(B.strengths(one_signal(spark, sf_dir)[0]), Config(rebalance_every=2, hold_every=4))).select("symbol", "dt", "s")


@query("b6_weights", f"WITH {WEIGHTS} SELECT symbol, dt, round(w, 6) AS w FROM weights")
def b6_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.weights(one_signal(spark, sf_dir)[0], CONFIG)).select("symbol", "dt", "w")


@query("b7_replay", f"WITH {REPLAYED} SELECT dt, round(ret, 6) AS ret, round(turnover, 6) AS turnover, round(gross, 6) AS gross FROM daily")
def b7_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns, turnover and gross with costs, two passes."""
    signal, panel = one_signal(spark, sf_dir)
    return rounded(B.replay(B.weights(signal, CONFIG), panel, CONFIG.cost_bps)).select("dt", "ret", "turnover", "gross")


@query("b10_delisted", f"WITH {PANEL}, m AS (SELECT symbol, dt, open, close, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastc, open IS NULL AND lag(open) OVER (PARTITION BY symbol ORDER BY dt) IS NOT NULL AS settled FROM panel) SELECT symbol, dt, settled, round(CASE WHEN settled THEN lastc ELSE open END, 4) AS open, round(CASE WHEN settled THEN lastc ELSE close END, 4) AS close FROM m")
def b10_delisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.settle_delisted(brand_panel(spark, sf_dir)), 4).select("symbol", "dt", "settled", "open", "close")


@query("b11_cheat_return", f"WITH {BOOK} SELECT dt, round(sum(coalesce(s, 0) * coalesce(close / open - 1, 0)), 6) AS cheat FROM book JOIN panel USING (symbol, dt) GROUP BY dt")
def b11_cheat_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.unlagged_return(*one_signal(spark, sf_dir))).select("dt", "cheat")


# --- metrics, windows, verdicts -----------------------------------------------------------------------------------------
RF, PPY = CONFIG.risk_free / CONFIG.periods_per_year, CONFIG.periods_per_year


def metrics_sql(source: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""navs AS (SELECT *, exp(sum(CASE WHEN ret > -1 THEN ln(1 + ret) END) OVER ({part}ORDER BY dt)) AS nav, max(ret <= -1) OVER ({part}ORDER BY dt) AS ruined FROM {source} WHERE ret IS NOT NULL),
drops AS (SELECT *, nav / greatest(1, max(nav) OVER ({part}ORDER BY dt)) - 1 AS drop_ FROM navs),
raw_metrics AS (SELECT {keys}count(ret) AS n, avg(ret - {RF!r}) AS mean_ex, stddev_samp(ret) AS sd, sqrt(avg(pow(least(ret - {RF!r}, 0), 2))) AS down, sum(CASE WHEN ret > -1 THEN ln(1 + ret) END) AS growth, min(drop_) AS low, bool_or(ruined) AS ruined,
  avg((ret > 0)::INT::DOUBLE) AS hit_rate, avg(turnover) AS avg_turnover, avg(abs(gross)) AS avg_gross, count(*) FILTER (abs(gross) > 1e-8) AS n_active FROM drops {f'GROUP BY {by}' if by else ''}),
basic AS (SELECT *, CASE WHEN n >= 2 AND NOT ruined THEN exp(growth * {PPY!r} / n) - 1 END AS cagr, CASE WHEN n >= 2 AND NOT ruined THEN least(low, 0) END AS maxdd, n >= 2 AND NOT ruined AS enough FROM raw_metrics),
metrics AS (SELECT {keys}CASE WHEN enough AND down > 1e-12 THEN mean_ex * sqrt({PPY!r}) / down END AS sortino, CASE WHEN enough AND sd > 1e-12 THEN mean_ex * sqrt({PPY!r}) / sd END AS sharpe, CASE WHEN enough AND abs(maxdd) > 1e-12 THEN cagr / abs(maxdd) END AS calmar,
  cagr, cagr AS ann_return, maxdd, CASE WHEN enough THEN sd * sqrt({PPY!r}) END AS ann_vol, hit_rate, avg_turnover, avg_gross, n, n_active FROM basic)"""


SHOWN = ", ".join(f"round({m}, 6) AS {m}" if m not in ("n", "n_active") else m for m in M.NAMES)
ONE_SCORED = f"{REPLAYED}, {metrics_sql('daily', '')}"


@query("a_metrics", f"WITH {ONE_SCORED} SELECT {SHOWN} FROM metrics")
def a_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2-A12 over the whole history."""
    signal, panel = one_signal(spark, sf_dir)
    daily = B.replay(B.weights(signal, CONFIG), panel, CONFIG.cost_bps)
    return rounded(M.metrics(daily, ["candidate_id"], CONFIG)).drop("candidate_id")


@query("a1_nav", f"WITH {REPLAYED} SELECT dt, round(sum(ln(1 + ret)) OVER (ORDER BY dt), 6) AS log_nav FROM daily UNION ALL SELECT min(dt) - 1, 0::DOUBLE FROM daily")
def a1_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, panel = one_signal(spark, sf_dir)
    daily = B.replay(B.weights(signal, CONFIG), panel, CONFIG.cost_bps)
    return rounded(M.baseline(daily, ["candidate_id"]).select("dt", F.ln("nav").alias("log_nav")))


@query("a13_objectives", f"""WITH {ONE_SCORED}, long AS (UNPIVOT (SELECT sortino, sharpe, calmar, cagr, ann_return, hit_rate, maxdd, ann_vol, avg_turnover FROM metrics) ON COLUMNS(*) INTO NAME objective VALUE value),
o(objective, higher, neutral) AS (VALUES ('sortino', true, 0.0), ('sharpe', true, 0.0), ('calmar', true, 0.0), ('cagr', true, 0.0), ('ann_return', true, 0.0), ('hit_rate', true, 0.5), ('maxdd', true, NULL), ('ann_vol', false, NULL), ('avg_turnover', false, NULL))
SELECT objective, round(value, 6) AS value, round(CASE WHEN higher THEN value ELSE -value END, 6) AS goodness, coalesce(CASE WHEN higher THEN value > neutral ELSE value < neutral END, false) AS is_good FROM long JOIN o USING (objective)""")
def a13_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, A14."""
    signal, panel = one_signal(spark, sf_dir)
    table_ = M.metrics(B.replay(B.weights(signal, CONFIG), panel, CONFIG.cost_bps), ["candidate_id"], CONFIG)
    return rounded(M.long_metrics(table_, ["candidate_id"])).select("objective", "value", "goodness", "is_good")


SCHEDULE = "dates AS (SELECT make_date(y, 1, 1) AS research_date FROM (SELECT unnest(generate_series(1994, 1998)) AS y))"
WINDOWS = f"""{SCHEDULE}, cal AS (SELECT dt, row_number() OVER (ORDER BY dt) AS bar FROM (SELECT DISTINCT dt FROM panel)),
steps AS (SELECT research_date, lead(research_date) OVER (ORDER BY research_date) AS next_date, (SELECT coalesce(max(bar), 0) FROM cal WHERE dt <= research_date) AS bar_at FROM dates),
windows AS (SELECT research_date, CAST(research_date - INTERVAL {CONFIG.is_years} YEAR AS DATE) AS is_start, research_date AS is_end, (SELECT min(dt) FROM cal WHERE bar BETWEEN bar_at + 1 AND bar_at + {CONFIG.oos_bars}) AS oos_start,
  least((SELECT max(dt) FROM cal WHERE bar BETWEEN bar_at + 1 AND bar_at + {CONFIG.oos_bars}), coalesce(CAST(next_date - INTERVAL 1 DAY AS DATE), DATE '9999-12-31')) AS oos_end FROM steps)"""


def dates_of(spark: SparkSession) -> DataFrame:
    return V.schedule(spark, "1994-01-01", "1998-12-31", "YS")


@query("v1_windows", f"WITH {SETTLED}, {WINDOWS} SELECT * FROM windows")
def v1_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2, V6, V8, V10."""
    return V.research_windows(dates_of(spark), brand_settlement(spark, sf_dir).select("dt").distinct(), CONFIG)


#: Offset aliases: forward ones, and such as have to be refused.
ALIASES = {"YS": ("year", 1), "QS": ("quarter", 1), "2QS": ("quarter", 2), "MS": ("month", 1), "6MS": ("month", 6), "M": None, "-1QS": None, "H": None, "0MS": None}


@query("v7_frequencies", f"WITH s AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders), days AS (SELECT unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM s)" + " UNION ALL ".join(f" SELECT '{k}' AS alias, false AS refused, ceil(count(*) / {v[1]}::DOUBLE)::BIGINT AS n, min(d) AS first_date FROM days WHERE d = date_trunc('{v[0]}', d)::DATE" if v else f" SELECT '{k}', true, 0, NULL" for k, v in ALIASES.items()))
def v7_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6, V7: schedules over the span of the orders by offset alias; those below a day, backward or of an old spelling are refused."""
    a, z = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").cast("string"), F.max("o_orderdate").cast("date").cast("string")).first()
    found = []
    for alias in ALIASES:
        try:
            dates = V.schedule(spark, a, z, alias)
        except ValueError:
            found.append(spark.range(1).select(F.lit(alias).alias("alias"), F.lit(True).alias("refused"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("date").alias("first_date")))
        else:
            found.append(dates.agg(F.count(F.lit(1)).alias("n"), F.min("research_date").alias("first_date")).select(F.lit(alias).alias("alias"), F.lit(False).alias("refused"), "n", "first_date"))
    return reduce(DataFrame.unionByName, found)


PHASED = f"phased AS (SELECT d.*, w.research_date, CASE WHEN d.dt <= w.is_end THEN 'IS' ELSE 'OOS' END AS phase FROM daily d JOIN windows w ON (d.dt BETWEEN w.is_start AND w.is_end) OR (d.dt > w.is_end AND d.dt BETWEEN w.oos_start AND w.oos_end))"


@query("v4_phase_bounds", f"WITH {REPLAYED}, {WINDOWS}, {PHASED} SELECT 'k3_reversal' AS candidate_id, research_date, phase, min(dt) AS first_dt, max(dt) AS last_dt, count(*) AS n_bars FROM phased GROUP BY ALL")
def v4_phase_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V4."""
    signal, panel = one_signal(spark, sf_dir)
    daily = B.replay(B.weights(signal, CONFIG), panel, CONFIG.cost_bps)
    return V.phase_bounds(V.in_phases(daily, V.research_windows(dates_of(spark), panel.select("dt").distinct(), CONFIG)))


def reasons_sql(mark: str = "; ") -> str:
    """The reasons of a verdict from is_value, oos_value, a and b (live bars), na and nb (bars), ga, gb, ca, cb."""
    few = lambda phase, live, n, least: f"CASE WHEN coalesce({live}, 0) < {least} THEN printf('insufficient {phase} observations with live exposure (%d < {least}; %d bar(s) scored)', coalesce({live}, 0), coalesce({n}, 0)) END"
    shown = lambda x: f"CASE WHEN {x} IS NULL THEN 'nan' WHEN abs({x}) < 1e6 THEN printf('%.4f', {x}) ELSE printf('%.3e', {x}) END"
    return f"""concat_ws('{mark}', {few('IS', 'a', 'na', CONFIG.min_is_bars)}, {few('OOS', 'b', 'nb', CONFIG.min_oos_bars)}, CASE WHEN NOT coalesce(ga > 1e-8 AND gb > 1e-8, false) THEN 'inactive strategy: average gross exposure is ~0' END,
  CASE WHEN NOT coalesce(oos_value >= {CONFIG.pass_line}, false) THEN concat('OOS Sharpe ', {shown('oos_value')}, ' fails the pass line (>= {CONFIG.pass_line})') END,
  CASE WHEN NOT coalesce(ca > 0 AND cb > 0, false) THEN concat('IS/OOS not consistently profitable (IS ', {shown('ca')}, ', OOS ', {shown('cb')}, ')') END)"""


@query("v5_verdict", f"""WITH {REPLAYED}, {WINDOWS}, {PHASED}, {metrics_sql('phased', 'research_date, phase')},
j AS (SELECT i.research_date, i.sharpe AS is_value, o.sharpe AS oos_value, i.n_active AS a, o.n_active AS b, i.n AS na, o.n AS nb, i.avg_gross AS ga, o.avg_gross AS gb, i.cagr AS ca, o.cagr AS cb FROM metrics i LEFT JOIN metrics o ON i.research_date = o.research_date AND o.phase = 'OOS' WHERE i.phase = 'IS')
SELECT research_date, round(is_value, 6) AS is_value, round(oos_value, 6) AS oos_value, coalesce(a >= {CONFIG.min_is_bars} AND b >= {CONFIG.min_oos_bars} AND ga > 1e-8 AND gb > 1e-8 AND oos_value >= {CONFIG.pass_line} AND ca > 0 AND cb > 0, false) AS passed,
  {reasons_sql()} AS reasons FROM j""")
def v5_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, panel = one_signal(spark, sf_dir)
    daily = B.replay(B.weights(signal, CONFIG), panel, CONFIG.cost_bps)
    judged = V.verdicts(G.scored(daily, V.research_windows(dates_of(spark), panel.select("dt").distinct(), CONFIG), CONFIG), CONFIG)
    return rounded(judged.select("research_date", "is_value", "oos_value", "passed", F.array_join("reasons", "; ").alias("reasons")))


@query("v9_required_window", f"WITH {SETTLED}, {WINDOWS} SELECT (SELECT dt FROM cal WHERE bar = greatest(1, (SELECT min(bar) FROM cal WHERE dt >= (SELECT min(is_start) FROM windows)) - 16)) AS need_from, (SELECT max(oos_end) FROM windows) AS need_to")
def v9_required_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = brand_settlement(spark, sf_dir).select("dt").distinct()
    return V.required_window(V.research_windows(dates_of(spark), cal, CONFIG), cal, 16)


# --- diagnostics --------------------------------------------------------------------------------------------------------
IC = f"""{SIGNAL}, fwd AS (SELECT symbol, dt, lead(returns) OVER (PARTITION BY symbol ORDER BY dt) AS f, lead(dt) OVER (PARTITION BY symbol ORDER BY dt) AS fdt FROM panel),
pairs AS (SELECT symbol, dt, value, f FROM signal JOIN fwd USING (symbol, dt) WHERE value IS NOT NULL AND f IS NOT NULL AND dt >= '1993-01-01' AND fdt <= '1997-01-06'),
ranked AS (SELECT dt, rank() OVER (PARTITION BY dt ORDER BY value) + (count(*) OVER (PARTITION BY dt, value) - 1) / 2::DOUBLE AS rs, rank() OVER (PARTITION BY dt ORDER BY f) + (count(*) OVER (PARTITION BY dt, f) - 1) / 2::DOUBLE AS rf FROM pairs),
ics AS (SELECT dt, covar_samp(rs, rf) / (stddev_samp(rs) * stddev_samp(rf)) AS ic FROM ranked GROUP BY dt HAVING count(*) >= 3 AND stddev_samp(rs) > 0 AND stddev_samp(rf) > 0)"""


@query("d2_daily_ic", f"WITH {IC} SELECT dt, round(ic, 6) AS ic FROM ics")
def d2_daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman by date."""
    signal, panel = one_signal(spark, sf_dir)
    return rounded(D.daily_ic(signal, panel, "1993-01-01", "1997-01-06")).select("dt", "ic")


@query("d3_sign_check", f"WITH {IC} SELECT round(avg(ic), 6) AS ic, count(*) AS days, abs(avg(ic)) >= 0.02 AND (avg(ic) > 0) <> (1 > 0) AS contradicts FROM ics")
def d3_sign_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, panel = one_signal(spark, sf_dir)
    checked = D.sign_check(D.mean_ic(signal, panel, "1993-01-01", "1997-01-06"), catalog(spark).select("candidate_id", "expected_sign"))
    return rounded(checked.select("ic", "days", "contradicts"))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as prose of candidates on all fields; odd turns speak of a panel without a VWAP of its own."""
    bars = brand_bars(spark, sf_dir, "month")
    kinds = [P.genuine_vwap(df).select(F.lit(k).alias("kind"), F.when(c("genuine"), "source").otherwise("hlc3").alias("vwap_source")) for k, df in enumerate((bars, bars.withColumn("vwap", F.lit(None).cast("double"))))]
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn", F.coalesce("role", F.lit(""))).alias("candidate_id"), F.array(*map(F.lit, FIELDS)).alias("fields"), "text", F.pmod("turn", F.lit(2)).cast("int").alias("kind"))
    return turns.join(F.broadcast(kinds[0].union(kinds[1])), "kind")  # two rows


PROSE_SQL = "p AS (SELECT conv_id || '-' || turn || '-' || coalesce(role, '') AS candidate_id, lower(text) AS t, turn % 2 = 1 AS proxy FROM conversations)"


def said_sql(stems: list[str]) -> str:
    return " OR ".join(f"contains(t, '{s}')" if " " in s or "-" in s else f"regexp_matches(t, '\\b{s}')" for s in stems)


MENTIONS = {f: said_sql(stems) for f, stems in D.STEMS.items()}
MENTIONS["vwap"] = f"CASE WHEN proxy THEN {said_sql([*D.STEMS['typical_price'], 'vwap'])} ELSE {MENTIONS['vwap']} END"


@query("d4_unmentioned", f"WITH {PROSE_SQL} " + " UNION ALL ".join(f"SELECT candidate_id, '{f}' AS field FROM p GROUP BY candidate_id HAVING NOT coalesce(bool_or({sql}), false)" for f, sql in MENTIONS.items()))
def d4_unmentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight fields, on panels with and without a VWAP of their own."""
    return D.unmentioned_fields(prose(spark, sf_dir))


CLAIM_SQL = "concat_ws(', ', " + ", ".join(f"CASE WHEN proxy AND contains(t, '{x}') THEN '{x}' END" for x in sorted(D.VOLUME_CLAIMS)) + ")"


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose, every third conversation with a claim of volume at its end, as the turns make none."""
    long = F.coalesce(F.length("text"), F.lit(0))
    claim = F.element_at(F.array(*map(F.lit, D.VOLUME_CLAIMS)), (F.floor(long / 3) % len(D.VOLUME_CLAIMS) + 1).cast("int"))
    return prose(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.when(long % 3 == 0, F.concat(F.lit(" The "), claim)).otherwise("")))


TOLD = f"claims(k, phrase) AS (VALUES {', '.join(f'({i}, {x!r})' for i, x in enumerate(D.VOLUME_CLAIMS))}), p AS (SELECT candidate_id, proxy, lower(coalesce(text, '') || CASE WHEN coalesce(length(text), 0) % 3 = 0 THEN ' The ' || phrase ELSE '' END) AS t FROM (SELECT *, conv_id || '-' || turn || '-' || coalesce(role, '') AS candidate_id, turn % 2 = 1 AS proxy FROM conversations) JOIN claims ON k = coalesce(length(text), 0) // 3 % {len(D.VOLUME_CLAIMS)})"


@query("d5_volume_claims", f"WITH {TOLD} SELECT candidate_id, {CLAIM_SQL} AS claims FROM p")
def d5_volume_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.volume_claims(told(spark, sf_dir)).select("candidate_id", F.array_join("claims", ", ").alias("claims"))


@query("d5_vwap_warnings", f"WITH {TOLD}, said AS (SELECT candidate_id, {CLAIM_SQL} AS claims FROM p) SELECT candidate_id, 'claims of volume (' || claims || ') about a vwap that is a typical price' AS warning FROM said WHERE claims <> ''")
def d5_vwap_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.vwap_warnings(told(spark, sf_dir))


@query("d6_prose_faults", r"""WITH t AS (SELECT conv_id, turn, role, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS r, trim(lower(regexp_replace(role, '\s+', ' ', 'g'))) AS m FROM conversations)
SELECT conv_id || '-' || turn || '-' || coalesce(role, '') AS candidate_id, fault FROM (SELECT *, 'short rationale' AS fault FROM t WHERE length(r) < 40 UNION ALL SELECT *, 'short mechanism' FROM t WHERE length(m) < 40 UNION ALL SELECT *, 'rationale repeats mechanism' FROM t WHERE r = m UNION ALL SELECT *, 'prose repeats formula' FROM t WHERE r = 'rank(close)' OR m = 'rank(close)')""")
def d6_prose_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rationale, roles as mechanism."""
    df = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn", F.coalesce("role", F.lit(""))).alias("candidate_id"), c("text").alias("rationale"), c("role").alias("mechanism"), F.lit("rank(close)").alias("formula"))
    return D.prose_faults(df)


# --- research and journal -----------------------------------------------------------------------------------------------
#: Where the daily returns of the whole catalog were written, by application and version of the input; some twenty queries read them.
DAILY: dict[tuple, str] = {}


def grid_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, *version(spark, sf_dir, "lineitem", "part"))
    if key not in DAILY:
        panel, path = brand_settlement(spark, sf_dir), shared_dir(spark)
        B.replay(B.weights(stable_signals(panel), CONFIG), panel, CONFIG.cost_bps).write.parquet(path)
        DAILY[key] = path
    return spark.read.parquet(DAILY[key])


def grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    daily = grid_daily(spark, sf_dir)  # a row for every date of the panel and candidate
    windows = V.research_windows(dates_of(spark), daily.select("dt").distinct(), CONFIG)
    return G.scored(daily, windows, CONFIG).join(F.broadcast(catalog(spark).select("candidate_id", "candidate", "ops", "expression_hash")), "candidate_id"), windows


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every admitted candidate of every date, judged; dates of even and odd years are two runs, whose results don't compare."""
    table_, windows = grid(spark, sf_dir)
    judged = V.verdicts(G.eligible(table_, CONFIG), CONFIG).join(F.broadcast(windows), "research_date")
    runs = judged.withColumns({"run_id": F.concat(F.lit("run-"), F.year("research_date") % 2), "data_version": F.lit("v1")})
    return runs.withColumn("context", J.evidence_context(["objective", "run_id"]))


GRID_BOOK = f"""{SETTLED}{SIGNALS}, centred AS (SELECT *, value - avg(value) OVER (PARTITION BY candidate_id, dt) AS z FROM signal), book AS (SELECT candidate_id, symbol, dt, z / nullif(sum(abs(z)) OVER (PARTITION BY candidate_id, dt), 0) AS s FROM centred),
weights AS (SELECT candidate_id, symbol, dt, coalesce(lag(s) OVER (PARTITION BY candidate_id, symbol ORDER BY dt), 0) AS w FROM book)"""
GRID_DAILY = replay_sql(CONFIG.cost_bps / 1e4, 2)[len(WEIGHTS):].replace("SELECT w.symbol", "SELECT w.candidate_id, w.symbol").replace("PARTITION BY w.dt", "PARTITION BY w.candidate_id, w.dt").replace("PARTITION BY dt", "PARTITION BY candidate_id, dt").replace("PARTITION BY symbol", "PARTITION BY candidate_id, symbol").replace("(SELECT symbol, dt, w, x", "(SELECT candidate_id, symbol, dt, w, x").replace("(SELECT dt, max(intra)", "(SELECT candidate_id, dt, max(intra)").replace("GROUP BY dt", "GROUP BY candidate_id, dt")
GRID = f"{GRID_BOOK}{GRID_DAILY}, {WINDOWS}, {PHASED}, {metrics_sql('phased', 'candidate_id, research_date, phase')}, scored AS (SELECT i.candidate_id, i.research_date, i.sharpe AS is_value, o.sharpe AS oos_value, i.n_active AS is_active, o.n_active AS oos_active, i.n_active AS a, o.n_active AS b, i.n AS na, o.n AS nb, i.avg_gross AS ga, o.avg_gross AS gb, i.cagr AS ca, o.cagr AS cb FROM metrics i LEFT JOIN metrics o ON i.candidate_id = o.candidate_id AND i.research_date = o.research_date AND o.phase = 'OOS' WHERE i.phase = 'IS')"
PASSED = f"coalesce(is_active >= {CONFIG.min_is_bars} AND oos_active >= {CONFIG.min_oos_bars} AND ga > 1e-8 AND gb > 1e-8 AND oos_value >= {CONFIG.pass_line} AND ca > 0 AND cb > 0, false)"
LEDGER = f"{GRID}, ledger AS (SELECT s.*, w.oos_end, {PASSED} AS passed FROM scored s JOIN windows w USING (research_date) WHERE ga > 1e-8 AND is_active >= {CONFIG.min_is_bars})"


@query("g1_grid_scores", f"WITH {GRID} SELECT candidate_id, research_date, round(is_value, 5) AS is_value, round(oos_value, 5) AS oos_value, is_active, oos_active FROM scored")
def g1_grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates on all dates."""
    return rounded(grid(spark, sf_dir)[0].select("candidate_id", "research_date", c("is_sharpe").alias("is_value"), c("oos_sharpe").alias("oos_value"), c("is_n_active").alias("is_active"), c("oos_n_active").alias("oos_active")), 5)


@query("g3_best", f"WITH {LEDGER} SELECT research_date, candidate_id, round(is_value, 5) AS is_value, passed FROM ledger QUALIFY row_number() OVER (PARTITION BY research_date ORDER BY coalesce(is_value, '-infinity'::DOUBLE) DESC, list_position([{', '.join(repr(r[0]) for r in CATALOG)}], candidate_id)) = 1")
def g3_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility and the best of each date."""
    best = V.verdicts(G.best(grid(spark, sf_dir)[0], CONFIG), CONFIG)
    return rounded(best.select("research_date", "candidate_id", "is_value", "passed"), 5)


ADMITTED = f"admitted AS (SELECT candidate_id, research_date FROM signal JOIN windows ON dt BETWEEN is_start AND is_end GROUP BY ALL HAVING {OUTCOME} = 'ADMITTED')"


@query("g5_walk_forward", f"""WITH {LEDGER}, {ADMITTED}, chosen AS (SELECT * FROM ledger JOIN admitted USING (candidate_id, research_date) QUALIFY row_number() OVER (PARTITION BY research_date ORDER BY coalesce(is_value, '-infinity'::DOUBLE) DESC, {ORDER_OF}) = 1)
SELECT research_date, candidate_id, round(is_value, 5) AS is_value, round(oos_value, 5) AS oos_value, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS label, {reasons_sql()} AS reasons, oos_end FROM chosen""")
def g5_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the walk-forward ledger with verdicts and reasons."""
    panel = brand_settlement(spark, sf_dir)
    led = G.walk_forward(panel, dates_of(spark), CONFIG, values=stable_signals(panel, faults=True))
    return rounded(led.select("research_date", "candidate_id", "is_value", "oos_value", "label", F.array_join("reasons", "; ").alias("reasons"), "oos_end"), 5)


VOLUMES = [r for r in CATALOG if r[0] in ("k1_volume", "k8_corr")]
SPOILT = SETTLED.replace("panel AS (SELECT symbol", "clean AS (SELECT symbol") + ", panel AS (SELECT * REPLACE (CASE WHEN dt = (SELECT min(dt) FROM clean WHERE dt > '1996-02-10' AND volume IS NOT NULL) AND volume IS NOT NULL THEN 'infinity'::DOUBLE ELSE volume END AS volume) FROM clean)"
ONLY = "candidate_id IN ('k1_volume', 'k8_corr')"


@query("g9_numerical_reject", f"""WITH {LEDGER.replace(SETTLED, SPOILT, 1).replace('generate_series(1994, 1998)', 'generate_series(1996, 2000)')}, {faults_sql([r[0] for r in VOLUMES])},
marked AS (SELECT research_date, f.candidate_id, count(*) FILTER (fault AND dt <= is_end) AS before, count(*) FILTER (fault AND dt > is_end) AS after FROM fault_cells f JOIN windows ON dt BETWEEN is_start AND is_end OR dt > is_end AND dt BETWEEN oos_start AND oos_end GROUP BY ALL),
chosen AS (SELECT l.*, after FROM ledger l JOIN marked m USING (candidate_id, research_date) WHERE {ONLY} AND before = 0 QUALIFY row_number() OVER (PARTITION BY research_date ORDER BY coalesce(is_value, '-infinity'::DOUBLE) DESC, {ORDER_OF}) = 1)
SELECT research_date, candidate_id, round(is_value, 5) AS is_value, CASE WHEN after = 0 THEN round(oos_value, 5) END AS oos_value, CASE WHEN after > 0 THEN 'NUMERICAL_REJECT' WHEN passed THEN 'PASS' ELSE 'FAIL' END AS label,
  CASE WHEN after > 0 THEN 'non-finite values out of sample: ' || after ELSE {reasons_sql()} END AS reasons FROM chosen""")
def g9_numerical_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of one day after the first research date are infinite. Candidates of volume alone: the first date's is rejected
    for it, dates whose in-sample window holds that day have no candidate, later ones go on."""
    clean = brand_settlement(spark, sf_dir)
    day = clean.where("dt > '1996-02-10' AND volume IS NOT NULL").agg(F.min("dt").alias("spoilt"))
    hit = c("spoilt").isNotNull() & c("volume").isNotNull()
    panel = clean.join(F.broadcast(day), c("dt") == c("spoilt"), "left").withColumn("volume", F.when(hit, F.lit(float("inf"))).otherwise(c("volume"))).drop("spoilt")
    dates = V.schedule(spark, "1996-01-01", "2000-12-31", "YS")
    led = G.walk_forward(panel, dates, CONFIG, rows=VOLUMES, values=stable_signals(panel, VOLUMES, faults=True))
    return rounded(led.select("research_date", "candidate_id", "is_value", "oos_value", "label", F.array_join("reasons", "; ").alias("reasons")), 5)


PRIORS = f"{LEDGER}, best AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY research_date ORDER BY coalesce(is_value, '-infinity'::DOUBLE) DESC, candidate_id) = 1)"


def best_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(spark, sf_dir)
    order = Window.partitionBy("research_date").orderBy(M.goodness(c("is_value"), F.lit(True)).desc(), "candidate_id")
    return led.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


@query("g6_visible_priors", f"WITH {PRIORS} SELECT t.research_date, p.research_date AS prior_date, p.candidate_id AS prior_candidate FROM best t JOIN best p ON p.oos_end <= t.research_date AND p.research_date < t.research_date")
def g6_visible_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.visible_priors(best_ledger(spark, sf_dir)).select("research_date", "prior_date", "prior_candidate")


@query("g7_latest_failures", f"WITH {PRIORS}, v AS (SELECT t.research_date, p.research_date AS prior_date, p.candidate_id AS prior_candidate FROM best t JOIN best p ON p.oos_end <= t.research_date AND p.research_date < t.research_date WHERE NOT p.passed) SELECT research_date, prior_date, row_number() OVER (PARTITION BY research_date ORDER BY prior_date DESC)::INT AS age FROM v QUALIFY age <= 8")
def g7_latest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.latest_failures(best_ledger(spark, sf_dir)).select("research_date", "prior_date", "age")


@query("g8_summaries", f"WITH {LEDGER} SELECT research_date, candidate_id, CASE WHEN passed THEN 'win' ELSE 'failure' END AS kind, CASE WHEN passed THEN printf('sharpe out of sample %.4f', oos_value) ELSE {reasons_sql()} END AS detail FROM ledger")
def g8_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summaries(ledger(spark, sf_dir)).select("research_date", "candidate_id", "kind", "detail")


@query("g10_pending", f"WITH {LEDGER} SELECT research_date FROM dates WHERE research_date NOT IN (SELECT research_date FROM ledger WHERE research_date < '1996-06-01')")
def g10_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pending(dates_of(spark), ledger(spark, sf_dir).where(c("research_date") < "1996-06-01"))


@query("g11_history", f"WITH {GRID} SELECT research_date, count(*) AS n, string_agg(candidate_id, ',' ORDER BY list_position([{', '.join(repr(r[0]) for r in CATALOG)}], candidate_id)) AS tried, string_agg(coalesce(printf('%.4f', is_value), 'n/a'), ',' ORDER BY list_position([{', '.join(repr(r[0]) for r in CATALOG)}], candidate_id)) AS is_values FROM scored GROUP BY research_date")
def g11_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = G.history(grid(spark, sf_dir)[0], CONFIG.objective)
    return h.select("research_date", F.size("iterations").cast("long").alias("n"), F.array_join("iterations.candidate_id", ",").alias("tried"), F.array_join(F.transform("iterations.is_value", J.shown), ",").alias("is_values"))


@query("j1_merge", f"WITH {LEDGER}, both_ AS (SELECT research_date, candidate_id, 0 AS load FROM ledger UNION ALL SELECT research_date, candidate_id, 1 FROM ledger WHERE passed AND research_date > '1995-06-01') SELECT research_date, candidate_id FROM both_ QUALIFY row_number() OVER (PARTITION BY research_date ORDER BY load DESC, {ORDER_OF} DESC) = 1")
def j1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ledger, and the passes of later dates as the newer one; within a ledger the catalog's order is that of writing."""
    led = ledger(spark, sf_dir).select("research_date", "candidate_id", "candidate", "label")
    old, new = led.drop("label"), led.where("label = 'PASS' AND research_date > '1995-06-01'").drop("label")
    return J.merge_ledgers(old, new, "candidate").select("research_date", "candidate_id")


@query("j2_archive", "WITH old AS (SELECT 'r' || o_custkey AS run_id, min(o_orderpriority) AS note, min(o_orderdate)::VARCHAR AS first_archived, max(o_orderdate)::VARCHAR AS last_archived FROM orders WHERE o_orderdate < '1997-01-01' GROUP BY o_custkey), new AS (SELECT DISTINCT 'r' || o_custkey AS run_id FROM orders WHERE o_orderdate >= '1996-01-01') SELECT coalesce(o.run_id, n.run_id) AS run_id, coalesce(note, '') AS note, left(coalesce(first_archived, '2030-01-01'), 10) AS first_archived, left(CASE WHEN n.run_id IS NOT NULL THEN '2030-01-01' ELSE last_archived END, 10) AS last_archived FROM old o FULL JOIN new n ON o.run_id = n.run_id")
def j2_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs: those with orders before 1997 stand in the journal, those with orders since 1996 are archived again."""
    o = table(spark, sf_dir, "orders").withColumn("run_id", F.concat(F.lit("r"), "o_custkey"))
    old = o.where("o_orderdate < '1997-01-01'").groupBy("run_id").agg(F.min("o_orderpriority").alias("note"), F.min(c("o_orderdate").cast("date")).cast("string").alias("first_archived"), F.max(c("o_orderdate").cast("date")).cast("string").alias("last_archived"))
    return J.archive(old, o.where("o_orderdate >= '1996-01-01'").select("run_id").distinct(), "2030-01-01")


def settings(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(part).select(c("p_brand").alias("run"), c("p_type").alias("key"), c("p_size").cast("string").alias("value")).groupBy("run", "key").agg(F.max("value").alias("value"))


@query("j3_run_ids", """WITH s AS (SELECT p_brand AS run, p_type AS key, max(p_size::VARCHAR) AS value FROM part WHERE p_type <> 'STANDARD' GROUP BY ALL)
SELECT run, sha256(concat('[', string_agg(concat('{"key":"', key, '","value":"', value, '"}'), ',' ORDER BY key, value), ']v1')) AS run_id FROM s GROUP BY run""")
def j3_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.run_ids(settings(spark, sf_dir, "true"), ["STANDARD"], F.lit("v1"))


@query("j4_conflicts", "WITH a AS (SELECT p_type AS key, max(p_size::VARCHAR) AS v FROM part WHERE p_brand = 'Brand#11' GROUP BY 1), b AS (SELECT p_type AS key, max(p_size::VARCHAR) AS v FROM part WHERE p_brand = 'Brand#12' GROUP BY 1) SELECT coalesce(a.key, b.key) AS key, a.v AS left_value, b.v AS right_value FROM a FULL JOIN b ON a.key = b.key WHERE a.v IS DISTINCT FROM b.v")
def j4_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.config_conflicts(settings(spark, sf_dir, "p_brand = 'Brand#11'").drop("run"), settings(spark, sf_dir, "p_brand = 'Brand#12'").drop("run"), [])


LESSONS = f"{LEDGER}, lessons AS (SELECT candidate_id AS formula, passed AS won, 'run-' || (year(research_date) % 2) AS run_id, count(*) AS n_seen, max(research_date) AS research_date, CASE WHEN count(oos_end) = count(*) THEN max(oos_end) END AS oos_end, arg_max_null(oos_value, research_date) AS oos_value FROM ledger GROUP BY ALL)"


@query("j5_lessons", f"""WITH {LESSONS}, modes AS (SELECT candidate_id AS formula, run_id, string_agg(DISTINCT regexp_replace(reason, '-?[0-9]+([.][0-9]+)?', '#', 'g'), '; ' ORDER BY regexp_replace(reason, '-?[0-9]+([.][0-9]+)?', '#', 'g')) AS modes FROM (SELECT candidate_id, 'run-' || (year(research_date) % 2) AS run_id, unnest(string_split({reasons_sql('@')}, '@')) AS reason FROM ledger WHERE NOT passed) GROUP BY 1, 2)
SELECT formula, won, run_id, sha256('{{"objective":"sharpe","run_id":"' || run_id || '"}}') AS context, n_seen, research_date, oos_end, round(oos_value, 5) AS oos_value, CASE WHEN won THEN '' ELSE modes END AS modes FROM lessons LEFT JOIN modes USING (formula, run_id)""")
def j5_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.lessons(ledger(spark, sf_dir)).select("formula", "won", "run_id", "context", "n_seen", "research_date", "oos_end", "oos_value", F.array_join("modes", "; ").alias("modes")), 5)


@query("j6_top_losses", f"WITH {LESSONS} SELECT formula, n_seen FROM lessons WHERE NOT won ORDER BY n_seen DESC, formula LIMIT 15")
def j6_top_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.top_losses(J.lessons(ledger(spark, sf_dir))).select("formula", "n_seen")


@query("j6_top_wins", f"WITH {LESSONS} SELECT formula, research_date FROM lessons WHERE won ORDER BY research_date DESC, formula DESC LIMIT 10")
def j6_top_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.top_wins(J.lessons(ledger(spark, sf_dir))).select("formula", "research_date")


@query("j8_as_of", f"WITH {LESSONS} SELECT formula, won, n_seen FROM lessons WHERE oos_end <= '1997-12-31'")
def j8_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.as_of(J.lessons(ledger(spark, sf_dir)), "1997-12-31").select("formula", "won", "n_seen")


HISTORY = f"""{LEDGER}, states AS (SELECT candidate_id AS formula, passed AS won, oos_end AS known_from, row_number() OVER w AS n_seen, lead(oos_end) OVER w AS known_to, oos_value, research_date, year(research_date) % 2 AS run FROM ledger WHERE oos_end IS NOT NULL WINDOW w AS (PARTITION BY candidate_id, passed, year(research_date) % 2 ORDER BY oos_end, research_date)),
history AS (SELECT s.formula, s.won, s.known_from, s.known_to, s.n_seen, (SELECT arg_max_null(p.oos_value, p.research_date) FROM states p WHERE p.formula = s.formula AND p.won = s.won AND p.run = s.run AND p.known_from <= s.known_from) AS oos_value FROM states s WHERE s.known_to IS DISTINCT FROM s.known_from)"""


@query("j8_lesson_history", f"WITH {HISTORY} SELECT formula, won, known_from, known_to, n_seen, round(oos_value, 5) AS oos_value FROM history")
def j8_lesson_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could be known of each lesson, and from when to when."""
    return rounded(J.lesson_history(ledger(spark, sf_dir)).select("formula", "won", "known_from", "known_to", "n_seen", "oos_value"), 5)


@query("j8_known_lessons", f"WITH {HISTORY} SELECT formula, won, n_seen FROM history WHERE known_from <= '1997-06-30' AND coalesce(known_to > '1997-06-30', true)")
def j8_known_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.known_lessons(J.lesson_history(ledger(spark, sf_dir)), "1997-06-30").select("formula", "won", "n_seen")


def noted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The ledger with a mechanism for each candidate, a comment on its orders, and entries of its runs and one without results."""
    words = [(r[0], f"{r[1]} of  {r[2]} |\n{' and then '.join(r[7])}, as a story that is told at length so that it has to be cut") for r in CATALOG]
    led = ledger(spark, sf_dir).join(F.broadcast(spark.createDataFrame(words, "candidate_id string, mechanism string")), "candidate_id")
    days = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("run-"), F.year("o_orderdate") % 3).alias("run_id")).agg(F.min("o_orderdate").cast("date").cast("string").alias("first_archived"), F.max("o_orderdate").cast("date").cast("string").alias("last_archived"))
    return led, days.withColumn("note", F.concat(F.lit(" orders\n of "), "run_id"))


MECHANISMS = "mechanisms(candidate_id, flat) AS (VALUES " + ", ".join("('%s', '%s')" % (r[0], f"{r[1]} of {r[2]} \\| {' and then '.join(r[7])}, as a story that is told at length so that it has to be cut") for r in CATALOG) + ")"


@query("j12_run_tables", f"""WITH {LEDGER}, {MECHANISMS} SELECT 'run-' || (year(research_date) % 2) AS run_id, row_number() OVER (PARTITION BY year(research_date) % 2 ORDER BY research_date, candidate_id)::INT AS place, research_date, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS verdict,
  coalesce(printf('%.4f', is_value), 'n/a') AS is_shown, coalesce(printf('%.4f', oos_value), 'n/a') AS oos_shown, candidate_id AS formula, CASE WHEN length(flat) <= 80 THEN flat ELSE rtrim(left(flat, 77)) || '...' END AS mechanism FROM ledger JOIN mechanisms USING (candidate_id)""")
def j12_run_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of each run."""
    return J.run_tables(*noted(spark, sf_dir))


@query("j12_run_heads", f"""WITH {LEDGER}, runs AS (SELECT 'run-' || (year(research_date) % 2) AS run_id, count(*) AS n, count(*) FILTER (passed) AS won FROM ledger GROUP BY 1),
entries AS (SELECT 'run-' || (year(o_orderdate) % 3) AS run_id, min(o_orderdate)::DATE::VARCHAR AS a, max(o_orderdate)::DATE::VARCHAR AS z FROM orders GROUP BY 1)
SELECT run_id, 'orders of ' || run_id AS note, CASE WHEN a = z THEN a ELSE a || ' (refreshed ' || z || ')' END AS archived, CASE WHEN n IS NULL THEN '?' ELSE 'sharpe' END AS objective, coalesce(n, 0) || ' factor(s), ' || coalesce(won, 0) || ' PASS' AS result FROM entries LEFT JOIN runs USING (run_id)""")
def j12_run_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.run_heads(*noted(spark, sf_dir))


@query("j9_failure_modes", f"WITH {LEDGER}, r AS (SELECT unnest(string_split({reasons_sql('@')}, '@')) AS reason FROM ledger WHERE NOT passed) SELECT regexp_replace(reason, '-?[0-9]+([.][0-9]+)?', '#', 'g') AS mode, count(*) AS n FROM r GROUP BY 1")
def j9_failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.failure_modes(ledger(spark, sf_dir))


OPS = ", ".join("('%s', [%s])" % (r[0], ", ".join(f"'{o}'" for o in r[7])) for r in CATALOG)


@query("j10_operator_usage", f"WITH {LEDGER}, k(candidate_id, ops) AS (VALUES {OPS}) SELECT op, count(*) FILTER (passed) AS won, count(*) FILTER (NOT passed) AS lost FROM (SELECT passed, unnest(list_distinct(ops)) AS op FROM ledger JOIN k USING (candidate_id)) GROUP BY op")
def j10_operator_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.operator_usage(ledger(spark, sf_dir))


@query("j11_header", f"WITH {LEDGER} SELECT count(DISTINCT year(research_date) % 2) AS n_runs, count(*) AS n_factors, count(*) FILTER (passed) AS n_passed, round(count(*) FILTER (passed) / count(*)::DOUBLE, 6) AS pass_rate, min(research_date) AS first_date, max(research_date) AS last_date FROM ledger")
def j11_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.header(ledger(spark, sf_dir)))


@query("j14_run_listing", f"WITH {LEDGER} SELECT 'run-' || (year(research_date) % 2) AS run_id, research_date, candidate_id, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS label, round(is_value, 5) AS is_value, round(oos_value, 5) AS oos_value FROM ledger")
def j14_run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.run_listing(ledger(spark, sf_dir)), 5)


@query("j15_run_counts", f"WITH {LEDGER} SELECT 'run-' || (year(research_date) % 2) AS run_id, count(*) AS n, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, 0::BIGINT AS rejected FROM ledger GROUP BY 1")
def j15_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.run_counts(ledger(spark, sf_dir))


@query("j16_differences", "WITH a AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1), b AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1) SELECT coalesce(a.d, b.d) AS research_date, CASE WHEN a.d IS NULL THEN 'missing left' WHEN b.d IS NULL THEN 'missing right' ELSE 'n' END AS unequal FROM a FULL JOIN b ON a.d = b.d WHERE a.n IS DISTINCT FROM b.n")
def j16_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts by day of even and odd customers as two result sets."""
    o = table(spark, sf_dir, "orders").withColumn("research_date", c("o_orderdate").cast("date"))
    count = lambda side: o.where(f"o_custkey % 2 = {side}").groupBy("research_date").agg(F.count(F.lit(1)).alias("n"))
    return J.differences(count(0), count(1), ["n"]).select("research_date", F.array_join("unequal", ",").alias("unequal"))


@query("j17_usage", "SELECT 'r' || user_id AS run_id, sum(CASE WHEN event_type <> 'error' AND event_type <> 'view' THEN event_id END)::BIGINT AS input_tokens, sum(CASE WHEN event_type = 'click' THEN event_id END)::BIGINT AS output_tokens FROM events GROUP BY 1")
def j17_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage reports under two spellings."""
    e = table(spark, sf_dir, "events")
    kind = c("event_type")
    return J.usage_totals(e.select(F.concat(F.lit("r"), "user_id").alias("run_id"), F.when(kind == "click", c("event_id")).alias("input_tokens"), F.when(~kind.isin("click", "error", "view"), c("event_id")).alias("prompt_tokens"), F.when(kind == "click", c("event_id")).alias("output_tokens"), F.lit(None).cast("long").alias("completion_tokens")))


def redact_sql(x: str) -> str:
    """The masks in DuckDB's dialect, which has no lookahead: a bearer word that must stay gets a mark in front of it for the while."""
    for pattern, mask in J.SECRETS:
        groups, options = mask.replace("$", "\\"), "g"
        if "(?!bearer" in pattern:
            head = pattern.split("((?!bearer")[0].replace("'", "''")
            x = f"regexp_replace({x}, '{head}(bearer)\\b', '\\1\\2' || chr(1) || '\\3', 'g')"
            pattern = pattern.replace(r"(?!bearer\b)[^\s\"',]+", r"[^\s\"',\x01][^\s\"',]*")
        quoted = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{quoted}', '{groups}', '{options}')"
    return f"replace({x}, chr(1), '')"


@query("j18_redact", f"SELECT doc_id, sha256({redact_sql('text')}) AS redacted_sha256, {redact_sql('text')} <> text AS changed FROM documents")
def j18_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", F.sha2(J.redact(c("text")), 256).alias("redacted_sha256"), (J.redact(c("text")) != c("text")).alias("changed"))


# --- indicators ---------------------------------------------------------------------------------------------------------
cells("i1_turnover", lambda: I.turnover(c("close"), c("volume")) / 1e6, "close * volume / 1e6::DOUBLE")
cells("i5_acc_return", lambda: I.accumulated_return(c("close"), 4), f"close / {lag_sql('close', 4)} - 1")
cells("i8_slope", lambda: I.slope(c("close")), f"close - {lag_sql('close', 1)}")
cells("i9_prev_diff", lambda: I.previous_difference(c("close")), f"{lag_sql('close', 1)} - {lag_sql('close', 2)}")
cells("i10_prev_rollmax", lambda: I.previous_rolling_max(c("high")), "coalesce(max(high) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0)")
cells("i11_quantile", lambda: I.rolling_quantile(c("close"), 8, 0.25), "CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) = 8 THEN quantile_cont(close, 0.25) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) END")


def indicator(name: str, make: Callable[[DataFrame], DataFrame], columns: dict[str, str], steps: str = "", source: str = "panel") -> None:
    """Registers a query of (symbol, dt, columns); `columns` are name and SQL over `source`, which `steps` may define."""
    QUERIES[name] = lambda spark, sf_dir: rounded(make(brand_panel(spark, sf_dir)).select("symbol", "dt", *columns))
    SQL[name] = f"WITH {PANEL}{steps} SELECT symbol, dt, {', '.join(x if x == n else f'{x} AS {n}' for n, x in columns.items())} FROM {source}"


def before_sql(x: str, far: int, near_: int, agg: str) -> str:
    return f"{agg}({x}) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {far} PRECEDING AND {near_} PRECEDING)"


def halved_sql(x: str, window: int, half_life: float, lag: int = 0) -> str:
    """Half-life weights times x, over `window` rows that ended `lag` rows ago."""
    return "(" + " + ".join(f"{0.5 ** (k / half_life)!r}::DOUBLE * {lag_sql(x, k + lag) if k + lag else x}" for k in range(window)) + ")"


def smooth_sql(x: str, a: float) -> str:
    """The recursive average that starts at the first row."""
    return f"list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda p, v: p * {1 - a!r}::DOUBLE + v * {a!r}::DOUBLE)"


six = lambda x: f"round({x}, {DIGITS})"
indicator("i2_hma", lambda df: I.hull_average(df, "close", 9), {"hma": six(decay_sql("h", 3))}, f", h AS (SELECT symbol, dt, 2 * {decay_sql('close', 4)} - {decay_sql('close', 9)} AS h FROM panel)", "h")
EMA = f", valid AS (SELECT symbol, dt, close FROM panel WHERE close IS NOT NULL), a AS (SELECT *, {smooth_sql('close', 2 / 13)} - {smooth_sql('close', 2 / 27)} AS m FROM valid), b AS (SELECT *, {smooth_sql('m', 2 / 10)} AS s FROM a), j AS (SELECT p.symbol, p.dt, m, s FROM panel p LEFT JOIN b ON b.symbol = p.symbol AND b.dt = p.dt)"
indicator("i3_macd", I.macd, {"macd": six("m"), "macd_signal": six("s"), "macd_hist": six("m - s")}, EMA, "j")
RSI = f", valid AS (SELECT symbol, dt, close - {lag_sql('close', 1)} AS d FROM panel WHERE close IS NOT NULL), moved AS (SELECT symbol, dt, {smooth_sql('greatest(d, 0)', 1 / 14)} AS up, {smooth_sql('greatest(-d, 0)', 1 / 14)} AS down FROM valid WHERE d IS NOT NULL), j AS (SELECT p.symbol, p.dt, 100 * up / nullif(up + down, 0) AS r FROM panel p LEFT JOIN moved m ON m.symbol = p.symbol AND m.dt = p.dt)"
indicator("i4_rsi", I.rsi, {"rsi": six("r")}, RSI, "j")
PEAKS = f", m AS (SELECT symbol, dt, close, {lag_sql('close', 1)} AS b, {lag_sql('close', 2)} AS a FROM panel), marks AS (SELECT symbol, dt, CASE WHEN b > a AND b > close THEN b END AS p, CASE WHEN b < a AND b < close THEN b END AS q FROM m)"
indicator("i6_convergence", lambda df: I.convergence(df, "close", 12), {"peak_count": f"count(p) {frame_sql(12)}", "peak_max": six(f"max(p) {frame_sql(12)}"), "peak_diff": six(f"max(p) {frame_sql(12)} - min(p) {frame_sql(12)}"), "bottom_count": f"count(q) {frame_sql(12)}", "bottom_min": six(f"min(q) {frame_sql(12)}"), "bottom_mean": six(f"avg(q) {frame_sql(12)}"), "bottom_diff": six(f"max(q) {frame_sql(12)} - min(q) {frame_sql(12)}")}, PEAKS, "marks")
TOP, LOW = f"close > {before_sql('close', 12, 1, 'max')}", f"close < {before_sql('close', 12, 1, 'min')}"
WITH_TOP, WITH_LOW = f"volume > {before_sql('volume', 12, 1, 'max')}", f"volume < {before_sql('volume', 12, 1, 'min')}"
indicator("i7_divergence", lambda df: I.divergence(df, "close", "volume", 12), {"new_peak": f"({TOP}) AND ({WITH_TOP})", "fake_peak": f"({TOP}) AND NOT ({WITH_TOP})", "new_bottom": f"({LOW}) AND ({WITH_LOW})", "fake_bottom": f"({LOW}) AND NOT ({WITH_LOW})"})


def beta_sql(window: int, half_life: float) -> tuple[str, str]:
    """CTEs that end in sums, and the slope over them."""
    products = ", market AS (SELECT symbol, dt, returns AS r, avg(returns) OVER (PARTITION BY dt) AS m FROM panel), products AS (SELECT *, r * m AS rm, m * m AS mm FROM market)"
    sums = ", ".join(f"{halved_sql(c_, window, half_life)} AS {n}" for n, c_ in (("x", "m"), ("y", "r"), ("xy", "rm"), ("xx", "mm")))
    weight = repr(sum(0.5 ** (k / half_life) for k in range(window)))
    slope = f"CASE WHEN n = {window} THEN (xy - x * y / {weight}::DOUBLE) / nullif(xx - x * x / {weight}::DOUBLE, 0) END"
    return f"{products}, sums AS (SELECT symbol, dt, count(r) {frame_sql(window)} AS n, {sums} FROM products)", slope


BETA, SLOPE = beta_sql(26, 13.0)
indicator("i12_beta", lambda df: I.beta(df, 26, 13), {"beta": six(SLOPE)}, BETA, "sums")
indicator("i12_beta_w252", I.beta, {"beta": six(beta_sql(252, 63.0)[1])}, beta_sql(252, 63.0)[0], "sums")
indicator("i12_nonlinear_beta", lambda df: I.orthogonal_cube(I.beta(df, 26, 13), "beta", "nlbeta"), {"nlbeta": six("c - avg(c) OVER (PARTITION BY dt) - covar_samp(b, c) OVER (PARTITION BY dt) / nullif(var_samp(b) OVER (PARTITION BY dt), 0) * (b - avg(b) OVER (PARTITION BY dt))")}, BETA + f", betas AS (SELECT symbol, dt, {SLOPE} AS b FROM sums), cubes AS (SELECT *, pow(b, 3::DOUBLE) AS c FROM betas)", "cubes")
LOGS = ", logs AS (SELECT *, CASE WHEN returns > -1 THEN ln(1 + CASE WHEN returns > -1 THEN returns END) END AS r FROM panel)"
indicator("i13_momentum", lambda df: I.momentum(df, 24, 2, 12), {"momentum": six(f"CASE WHEN {before_sql('r', 25, 2, 'count')} = 24 THEN {halved_sql('r', 24, 12.0, 2)} END")}, LOGS, "logs")
indicator("i13_momentum_w120", I.momentum, {"momentum": six(f"CASE WHEN {before_sql('r', 124, 5, 'count')} = 120 THEN {halved_sql('r', 120, 60.0, 5)} END")}, LOGS, "logs")
SIZES = ", z AS (SELECT symbol, dt, ln(CASE WHEN close * volume > 0 THEN close * volume END) AS s FROM panel), cubes AS (SELECT *, pow(s, 3::DOUBLE) AS c FROM z)"
indicator("i14_size", I.size_factor, {"size": six("s"), "nlsize": six("c - avg(c) OVER (PARTITION BY dt) - covar_samp(s, c) OVER (PARTITION BY dt) / nullif(var_samp(s) OVER (PARTITION BY dt), 0) * (s - avg(s) OVER (PARTITION BY dt))")}, SIZES, "cubes")
SPREAD = LOGS + ", sums AS (SELECT *, returns - avg(returns) OVER (PARTITION BY dt) AS a, sum(r) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM logs)"
indicator("i15_resid_vol", lambda df: I.residual_volatility(df, 13), {"resid_vol": six(f"{std_sql('returns', 13)} * 0.75::DOUBLE + ({full_sql(f'max(l) {frame_sql(13)}', 13, 'l')} - {full_sql(f'min(l) {frame_sql(13)}', 13, 'l')}) * 0.15::DOUBLE + {std_sql('a', 13)} * 0.1::DOUBLE")}, SPREAD, "sums")
TRADED = ", t AS (SELECT symbol, dt, close * volume AS v FROM panel), sums AS (SELECT symbol, dt, " + ", ".join(f"{full_sql(f'sum(v) {frame_sql(w)}', w, 'v')} AS s{w}" for w in (4, 13, 26)) + " FROM t)"
indicator("i16_liquidity", lambda df: I.liquidity(df, (4, 13, 26)), {"liquidity": six(" + ".join(f"ln(CASE WHEN s{w} > 0 THEN s{w} END) * {b}::DOUBLE" for w, b in ((4, 0.35), (13, 0.35), (26, 0.3))))}, TRADED, "sums")

SQL = {name: near_sql(sql) for name, sql in SQL.items()}
