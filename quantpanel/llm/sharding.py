"""Sharding by sampled splitters (DataFrame functions only). Law: `bytes`, all shards nearly equal in size.

Records are ordered by (xxhash64(text), id), so equal texts are neighbours.

1. A sample in which a record's chance grows with its size gives splitters at its quantiles: many small key ranges of
   about equal bytes. Ranges that turn out overfull (sampling error, or one text that a third of all rows share; the id
   is part of the key) are subdivided by a denser sample of their own.
2. Byte and row totals of the ranges, some hundred or a number for every `range_bytes`, give each range its offset; a window inside each range adds
   the running size. No task sees more than one range.
3. A shard starts where the running size passes k/shards of the total. A start that falls inside a small group of equal
   texts moves to the start of the group, so only groups above `group_share` of a shard are divided.

Defined cases: null text has size 8 and CRC-32 0; null ids sort first; repeated rows get slots of their own in any
order; an empty table gives an empty result; a corpus of fewer records than shards leaves shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantpanel.llm.common import cut, table

LOWEST = -(2**63)


def place(bounds: list[tuple[int, int]]) -> Column:
    """Number of sorted `bounds` at or below the row's key, as a balanced tree of comparisons."""

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        h, oid = bounds[mid]
        return f"if(h > {h}L OR (h = {h}L AND oid >= {oid}L), {tree(mid + 1, high)}, {tree(low, mid)})"

    return F.expr(tree(0, len(bounds)))


#: Rows of a table of ranges that is sent to all tasks, some 100 bytes each; a larger one is shuffled.
MOST_SENT = 1_000_000


def located(keyed: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """`keyed` with range, the number of `bounds` at or below the row's key.

    Few bounds are a tree of comparisons. Many are a table that is joined by the first 16 bits of the hash, each range at
    every value it covers, so it has at most 65,536 rows more than there are ranges.
    """
    if len(bounds) <= 256:
        return keyed.withColumn("range", place(bounds))
    lows, highs = [(LOWEST, LOWEST), *bounds], [*bounds, None]
    rows = [(i, *low, *(high or (None, None)), low[0] >> 48, (high[0] if high else 2**63 - 1) >> 48) for i, (low, high) in enumerate(zip(lows, highs, strict=True))]
    table_ = keyed.sparkSession.createDataFrame(rows, "range int, low_h long, low_oid long, high_h long, high_oid long, first int, last int")
    table_ = table_.withColumn("slot", F.explode(F.sequence("first", "last"))).drop("first", "last")
    if len(rows) + 65_536 <= MOST_SENT:
        table_ = F.broadcast(table_)
    above = (F.col("h") > F.col("low_h")) | ((F.col("h") == F.col("low_h")) & (F.col("oid") >= F.col("low_oid")))
    below = F.col("high_h").isNull() | (F.col("h") < F.col("high_h")) | ((F.col("h") == F.col("high_h")) & (F.col("oid") < F.col("high_oid")))
    joined = keyed.withColumn("slot", F.shiftright("h", 48).cast("int")).join(table_, "slot").where(above & below)
    return joined.select(*keyed.columns, "range")


def quantiles(keys: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    keys = sorted(keys)
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def splitters(keyed: DataFrame, total: int, ranges: int, oversample: int, rounds: int) -> tuple[list[tuple[int, int]], list]:
    """Boundaries of the key ranges and, by range, (range, bytes, rows). The sample has about ranges * oversample rows."""
    chance = lambda rate: (F.pmod(F.xxhash64("oid", "h", F.lit(7)), F.lit(1 << 40)) < F.col("size") * F.lit(rate * (1 << 40)))
    take = lambda df: [(r["h"], r["oid"]) for r in df.select("h", "oid").collect()]
    bounds = quantiles(take(keyed.where(chance(ranges * oversample / total))), ranges)
    target = total / ranges
    for left in range(rounds, -1, -1):
        totals = sorted((r["range"], r["bytes"], r["rows"]) for r in located(keyed, bounds).groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect())
        over = {i: b for i, b, n in totals if b > 3 * target and n > 1}
        if not over or not left:
            return bounds, totals
        dense = located(keyed, bounds).where(F.col("range").isin(list(over))).where(chance(oversample * 2 / target))
        found: dict[int, list] = {}
        for r in dense.select("range", "h", "oid").collect():
            found.setdefault(r["range"], []).append((r["h"], r["oid"]))
        bounds = sorted({*bounds, *(k for i, keys in found.items() for k in quantiles(keys, 1 + int(2 * over[i] / target)))})
    raise AssertionError("unreachable")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 6, range_bytes: int = 4_000_000_000, oversample: int = 24, rounds: int = 3, group_share: float = 0.01) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A range has a sixth of a shard's bytes, or `range_bytes` if that is less, so what one task sorts doesn't grow with the
    corpus. Ranges that stay overfull after `rounds` subdivisions are still placed right, as one larger task each.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = cut(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("oid"),
    ))
    total = keyed.agg(F.sum("size")).first()[0] or 1
    bounds, totals = splitters(keyed, total, max(shards * ranges_per_shard, total // range_bytes), oversample, rounds)
    offset_bytes, offset_rows, b, n = [], [], 0, 0
    for i, size, rows in totals:
        offset_bytes.append((i, b, n))
        b, n = b + size, n + rows
    offsets = spark.createDataFrame(offset_bytes, "range int, bytes_before long, rows_before long")  # a row for each range
    if len(offset_bytes) <= MOST_SENT:
        offsets = F.broadcast(offsets)
    order = Window.partitionBy("range").orderBy("h", "oid")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = located(keyed, bounds).join(offsets, "range")
    middle = F.col("bytes_before") + F.sum("size").over(running) - F.col("size") / 2
    first = placed.withColumn("raw", F.least(F.lit(shards - 1), F.floor(middle * shards / total))).groupBy("raw").agg(F.min(F.struct("h", "oid")).alias("key"))
    starts = {r["raw"]: (r["key"]["h"], r["key"]["oid"]) for r in first.collect()}  # one key a shard
    groups = {r["h"]: r["bytes"] for r in keyed.where(F.col("h").isin([k[0] for k in starts.values()])).groupBy("h").agg(F.sum("size").alias("bytes")).collect()} if starts else {}
    cuts = []
    for s in range(1, shards):
        key = starts.get(s)
        if key and groups[key[0]] <= group_share * total / shards:
            key = (key[0], LOWEST)
        cuts.append(key)
    # A shard without a start of its own is empty: it begins where the next one does.
    for s in range(shards - 2, -1, -1):
        if cuts[s] is None:
            cuts[s] = cuts[s + 1] if s + 1 < len(cuts) else (2**63 - 1, 2**63 - 1)
    numbered = placed.withColumn("shard", place(cuts).cast("int"))
    shard_rows = dict.fromkeys(range(shards), 0) | {r["shard"]: r["n"] for r in keyed.groupBy(place(cuts).alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shard_first, n = [], 0
    for s in range(shards):
        shard_first.append((s, n))
        n += shard_rows[s]
    begun = F.broadcast(spark.createDataFrame(shard_first, "shard int, shard_rows_before long"))
    slot = F.col("rows_before") + F.row_number().over(order) - 1 - F.col("shard_rows_before")
    return numbered.join(begun, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
