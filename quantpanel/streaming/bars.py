"""Daily bars from a stream of trades; the batch result over the same trades is equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(trades: DataFrame, key: Sequence[str], late: str = "1 day") -> DataFrame:
    """Bars of closed days of a stream (symbol, ts, price, volume, key columns); trades later than `late` are left out."""
    k = F.struct(*key)
    stamped = trades.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    bars = stamped.groupBy(F.window("event_time", "1 day").alias("w"), "symbol").agg(
        F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"),
        F.sum("volume").alias("volume"), F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap"),
    )
    return bars.select("symbol", F.to_date("w.start").alias("dt"), "open", "high", "low", "close", "volume", "vwap")
