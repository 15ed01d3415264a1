"""Reading and writing bars, ledgers, manifests, journals and signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quantpanel.operators.panel import from_wide

#: Time formats of raw downloads, tried in this order.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
LONG = {"Datetime": "ts", "Symbol": "symbol", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume", "Vwap": "vwap"}


def load_bars(spark: SparkSession, source: str, paths: Sequence[str], symbols: Sequence[str] | str = "all", start: str | None = None, end: str | None = None) -> DataFrame:
    """(ts, symbol, open, high, low, close, volume, vwap) from parquet, csv or wide parquet."""
    if source == "parquet":
        raw = spark.read.parquet(*paths)
        df = raw.select(*(F.col(a).alias(b) for a, b in LONG.items() if a in raw.columns))
    elif source == "csv":
        df = transcode(spark, paths)
    elif source == "wide":
        df = from_wide(spark.read.parquet(*paths)).withColumnRenamed("dt", "ts")
    else:
        raise ValueError(f"unknown source {source!r}")
    for name in ("volume", "vwap"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    return scan(df, symbols, start, end)


def scan(df: DataFrame, symbols: Sequence[str] | str = "all", start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Symbol and date filter; the end day is included whole, so a bar stamped 16:00 stays. Filters reach the scan."""
    if symbols != "all":
        df = df.where(F.col("symbol").isin(list(symbols)))
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.where(F.col(ts) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))


def all_symbols(df: DataFrame) -> DataFrame:
    return df.select("symbol").distinct().orderBy("symbol")


def transcode(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Raw CSV to bars: mixed time formats to midnight UTC, numbers coerced, rows without prices dropped, the first of repeated (symbol, time) in file order kept."""
    return clean(spark.read.csv(paths, header=True, inferSchema=False).withColumn("row", F.monotonically_increasing_id()))


def clean(raw: DataFrame) -> DataFrame:
    stamp = F.coalesce(*(F.try_to_timestamp("Date", F.lit(f)) for f in TIME_FORMATS))
    cells = raw.select(F.date_trunc("day", stamp).cast("timestamp_ntz").alias("ts"), F.col("Symbol").alias("symbol"), *(F.expr(f"try_cast(`{c}` AS double)").alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")), "row")
    kept = cells.na.drop(subset=["ts", "symbol", "open", "high", "low", "close"])
    first = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("row"))
    return kept.withColumn("n", first).where("n = 1").drop("n", "row")


def coverage_report(bars: DataFrame) -> DataFrame:
    """Rows, symbols, span, and least, median and most rows of a symbol."""
    by = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("lo"), F.max("dt").alias("hi"))
    return by.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_symbols"), F.min("lo").alias("first_dt"), F.max("hi").alias("last_dt"), F.min("n").alias("min_rows"), F.median("n").alias("median_rows"), F.max("n").alias("max_rows"))


def profiled_names(files: DataFrame, known_types: Sequence[str], regions: Sequence[str]) -> DataFrame:
    """Files (name) called Data_<TYPE>_<REGION>_D*: adds type, region and loadable; listed types need a known region."""
    parts = F.split("name", "_")
    shaped = (F.size(parts) >= 4) & (parts[0] == "Data") & F.coalesce(F.try_element_at(parts, F.lit(4)).startswith("D"), F.lit(False)) & F.endswith("name", F.lit(".parquet"))
    named = files.withColumns({"type": F.try_element_at(parts, F.lit(2)), "region": F.try_element_at(parts, F.lit(3))})
    return named.withColumn("loadable", shaped & F.coalesce(~F.col("type").isin(list(known_types)) | F.col("region").isin(list(regions)), F.lit(False)))


def discover(spark: SparkSession, folder: str, known_types: Sequence[str], regions: Sequence[str]) -> DataFrame:
    """Loadable files in a folder and one level below; only the listing is read. A folder called *.parquet is one file, whatever parts it has."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    names = F.split(F.substr("path", F.lit(len(root) + 2)), "/")  # below the folder
    depth = F.array_position(F.transform(names, lambda n: F.endswith(n, F.lit(".parquet"))), True).cast("int")
    placed = listing.where(depth <= 2).select(F.concat(F.lit(f"{root}/"), F.array_join(F.slice(names, 1, depth), "/")).alias("path"), "length", names[depth - 1].alias("name"))
    return profiled_names(placed.groupBy("path", "name").agg(F.sum("length").alias("length")).select("path", "length", "name"), known_types, regions).where("loadable")


def append_ledger(rows: DataFrame, path: str) -> None:
    """One JSON object a line, partitioned by run."""
    rows.write.mode("append").partitionBy("run_id").json(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and corrupt lines as (line)."""
    typed = T.StructType([*schema, T.StructField("corrupt", T.StringType())])
    rows = spark.read.schema(typed).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    text = spark.read.text(path, recursiveFileLookup=True)
    good = F.from_json("value", typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return rows.where(F.col("corrupt").isNull()).drop("corrupt"), text.where(good["corrupt"].isNotNull()).select(F.col("value").alias("line"))


def write_manifest(row: DataFrame, path: str) -> None:
    """The one manifest of a run, replaced whole."""
    row.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def load_entries(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Journal entries, one file each, oldest first; names that begin with _ and unreadable files are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(folder).withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return rows.where(~F.startswith("file", F.lit("_")) & F.col("run_id").isNotNull()).orderBy("first_archived", "run_id")


def truncate_trace(trace: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The first n entries of each run, as a new snapshot."""
    return trace.withColumn("r", F.row_number().over(Window.partitionBy("run_id").orderBy(order))).where(F.col("r") <= n).drop("r")


def register_signal(signal: DataFrame, calendar: DataFrame, path: str, feature_id: str) -> DataFrame:
    """Writes a signal under its id, aligned to the calendar, and reads it back."""
    signal.join(F.broadcast(calendar.select("dt")), "dt", "left_semi").withColumn("feature_id", F.lit(feature_id)).write.mode("append").partitionBy("feature_id").parquet(path)
    return signal.sparkSession.read.parquet(path).where(F.col("feature_id") == feature_id)
