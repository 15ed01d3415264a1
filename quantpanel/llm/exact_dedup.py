"""Exact deduplication with an extendible-hash index on shared files (DataFrame functions only).

1. Every text is normalised and hashed; (hash, rows) is written. The directory of the index starts with as many buckets as
   the links need and doubles for overfull buckets alone: a bucket is a prefix of the hash, so a split deals its links by
   one bit more. Only counters of buckets reach the driver. Links whose whole hash is equal can't be split; they chain.
2. Buckets in order are dealt to owner tasks, so an owner holds one range of keys. Texts go to the owner of their bucket;
   there texts of one hash are chained by comparing bytes, and the links of the range are written as a file of the index:
   bucket, hash, place in the chain, digest of the text, smallest id and number of rows.
3. A hash of more than `hot_rows` rows would swamp its owner, so its texts don't go there: its links are aggregated where
   they stand and are a small file of their own (there are at most rows / `hot_rows` such hashes).
4. `exact_dedup` lets documents probe the index by hash and digest, without their texts. `keep_first_copies` has to move
   whole rows anyway: they go to their owner with their text, and the chains that it builds decide there.

Defined cases: null text counts as empty; a null id never is the smallest unless all are null; rows with equal id and
equal text are one document and share its decision; rows of one id with different texts are judged each by its own text;
an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantpanel.llm.common import cut, table

#: Bits of a hash by which buckets are told apart.
DEPTH = 63


def normalised(text_col: str = "text") -> Column:
    """Runs of white space become one space; a single space is one already, so it isn't matched."""
    return F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def prefix(depth: int) -> Column:
    """The first `depth` bits of the key."""
    return F.shiftright("key", DEPTH - depth)


def directory(links: DataFrame, bucket_rows: int, hot_rows: int) -> list[tuple[int, int, int, int]]:
    """(first key, depth, links, rows without those of hot hashes) of every bucket, in order. `links` has key and n.

    Buckets that hold more than `bucket_rows` links split until none does or no bit is left.
    """
    spark = links.sparkSession
    total = links.count()
    depth, buckets = 0, []
    while depth < DEPTH and total > bucket_rows << depth:
        depth += 1
    rows = links
    while True:
        counts = rows.groupBy(prefix(depth).alias("p")).agg(F.count(F.lit(1)).alias("links"), F.sum(F.when(F.col("n") <= hot_rows, F.col("n")).otherwise(0)).alias("rows")).collect()
        full = [r["p"] for r in counts if r["links"] > bucket_rows and depth < DEPTH]
        over = set(full)
        buckets += [(r["p"] << (DEPTH - depth), depth, r["links"], r["rows"]) for r in counts if r["p"] not in over]
        if not full:
            break
        rows = links.join(spark.createDataFrame([(x,) for x in full], "p long"), prefix(depth) == F.col("p"), "left_semi")
        depth += 1
    return sorted(buckets)


def dealt(buckets: list[tuple[int, int, int, int]], owners: int) -> list[tuple[int, int, int]]:
    """(first key, depth, owner): consecutive buckets to one owner, all owners with about equal rows."""
    total, before, out = sum(b[3] for b in buckets) or 1, 0, []
    for first, depth, _, rows in buckets:
        out.append((first, depth, min(owners - 1, (before + rows // 2) * owners // total)))
        before += rows
    return out


class Owners:
    """The hashed documents, the directory of their buckets, and what goes to which owner.

    `keyed` has row (a struct of `columns`), doc_id, norm and key; `hot` are the keys that stay where they are, if any.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, columns: list[str], bucket_rows: int | None, hot_rows: int | None, hash_bits: int):
        spark = docs.sparkSession
        self.owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = docs.select((F.struct(*(docs[f"`{c}`"] for c in columns)) if columns else F.lit(0)).alias("row"), docs[f"`{id_col}`"].alias("doc_id"), normalised(text_col).alias("norm"))
        keyed = keyed.withColumn("key", F.shiftrightunsigned(F.xxhash64("norm"), 1))
        if hash_bits < DEPTH:  # tests force collisions
            keyed = keyed.withColumn("key", F.shiftleft(F.shiftright("key", DEPTH - hash_bits), DEPTH - hash_bits))
        self.keyed = keyed
        links = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        total = links.agg(F.sum("n")).first()[0] or 0
        bucket_rows = bucket_rows or max(64, min(65_536, total // (4 * self.owners)))
        hot_rows = hot_rows or max(256, total // (4 * self.owners))
        buckets = directory(links, bucket_rows, hot_rows)
        places = spark.createDataFrame([(f, f + (1 << (DEPTH - d)) - 1, i, o) for i, (f, d, o) in enumerate(dealt(buckets, self.owners))] or [(0, 2**63 - 1, 0, 0)], "low long, high long, bucket int, owner int")
        # Buckets share no more than their first bits: an equality for the join, the range for the rest.
        self.coarse = max(0, min((d for _, d, _, _ in buckets), default=0))
        places = places.withColumn("slot", F.shiftright("low", DEPTH - self.coarse))
        self.places = F.broadcast(places) if len(buckets) <= 1_000_000 else places
        found = links.where(F.col("n") > hot_rows).select(F.col("key").alias("hot_key"))
        self.hot = F.broadcast(found) if found.limit(1).count() else None  # total / hot_rows rows at most

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows (with key) that go to owners, and those of hot keys."""
        if self.hot is None:
            return rows, None
        same = F.col("key") == F.col("hot_key")
        return rows.join(self.hot, same, "left_anti"), rows.join(self.hot, same, "left_semi")

    def in_buckets(self, rows: DataFrame) -> DataFrame:
        """Rows with the owner and the bucket of their key."""
        return rows.withColumn("slot", F.shiftright("key", DEPTH - self.coarse)).join(self.places, "slot").where("key BETWEEN low AND high").drop("slot", "low", "high")

    def at_owners(self, rows: DataFrame) -> DataFrame:
        return self.in_buckets(rows).repartitionById(self.owners, F.col("owner"))


def index_of(owners: Owners) -> tuple[DataFrame, DataFrame | None]:
    """The written links (bucket, key, link, text_sha256, keep_id, group_size), and those of hot keys."""
    cold, hot = owners.split(owners.keyed.select("doc_id", "norm", "key"))

    def linked(texts: DataFrame, owned: list[str]) -> DataFrame:
        links = texts.groupBy(*owned, "key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        place = F.dense_rank().over(Window.partitionBy(*owned, "key").orderBy("norm"))
        return links.select(*owned, "key", place.alias("link"), F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")

    whole = cut(linked(owners.at_owners(cold), ["owner", "bucket"]).drop("owner"))
    return whole, None if hot is None else cut(owners.in_buckets(linked(hot, [])).drop("owner"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int | None = None, hot_rows: int | None = None, hash_bits: int = DEPTH) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and the bucket and link that hold it.

    By default a bucket has a quarter of a shuffle partition's rows at most (65,536 if that is less), and so has a group
    that counts as hot.
    """
    owners = Owners(docs, id_col, text_col, [], bucket_rows, hot_rows, hash_bits)
    index, hot_index = index_of(owners)
    cold, hot = owners.split(owners.keyed.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")))
    found = cold.join(index, ["key", "text_sha256"])
    if hot is not None:
        found = found.unionByName(hot.join(hot_index, ["key", "text_sha256"]))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "link")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    owners = Owners(docs, id_col, text_col, docs.columns, bucket_rows, hot_rows, DEPTH)
    cold, hot = owners.split(owners.keyed)
    link = Window.partitionBy("owner", "bucket", "key", "norm")
    kept = [owners.at_owners(cold).select("row", "doc_id", F.min("doc_id").over(link).alias("keep_id"))]
    if hot is not None:
        first = cut(hot.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id")).select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id"))
        kept.append(hot.select("row", "doc_id", "key", F.sha2("norm", 256).alias("text_sha256")).join(first, ["key", "text_sha256"]).select("row", "doc_id", "keep_id"))
    return reduce(DataFrame.unionByName, kept).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("bucket", "link")


SQL = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
