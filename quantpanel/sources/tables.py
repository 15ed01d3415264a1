"""Trades, bars and panels from the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.operators import panel as P

#: Orders the trades of one bar; unique in a symbol.
TRADE_KEY = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a local session may use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again, so that what is derived from it several times is made once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application wrote through shared_dir; for the end of it, when no result is read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def version(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """Number, size and last change of the tables' files: another one means that their rows may have changed."""
    one = lambda name: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/{name}.parquet")
    return tuple(x for n in names for x in one(n).agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime")).first())


def brand_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of their part's brand."""
    items = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 0)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return items.join(parts, "l_partkey").select("symbol", F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"))


def brand_bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    return P.resample(brand_trades(spark, sf_dir), unit, TRADE_KEY)


def brand_panel(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """The panel reads bars several times (cells, calendar, symbols, VWAP), so they are written once."""
    return P.panel(written(brand_bars(spark, sf_dir, unit)), "lineitem")


def brand_settlement(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    return P.settlement(written(brand_bars(spark, sf_dir, unit)))


def event_bars(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    trades = table(spark, sf_dir, "events").select(F.col(symbol).cast("string").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    return P.resample(trades, "day", ("ts", "event_id"))
