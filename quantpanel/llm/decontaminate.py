"""Benchmark decontamination by spaced-seed hashing.

A text is contaminated by an item if some `WINDOW` consecutive words of the item (all of a shorter one) stand in it, word
against word, with at most two words substituted (one in items of 8 or 9 words, none below 8). Words are lower-cased
runs of letters and digits. Items of fewer than five words never match.

A seed hashes five words at fixed distances and ignores those between; the three masks are such that every window with an
allowed number of substitutions keeps at least one seed whole (a test tries all patterns), so no overlap is missed.

1. Test seeds, with the word hashes around them, form a small table; a bit filter marks the hashes in it. It has some 32
   bits for each seed, 2**28 (32 MB) at most: beyond that it lets more seeds through, but never loses one.
2. Texts emit the seeds whose bit is set, with the word hashes around them, so little but hits is shuffled.
3. Both sides join on mask and hash; a seed table of at most `broadcast_rows` rows is broadcast, a larger one is
   shuffled, where adaptive execution splits a seed that very many texts hold. Each hit is verified along its diagonal.
   A shuffle lies between seeds and verification either way, so that no task has two Python workers at a time.

Defined cases: null and empty texts are clean; null ids are kept as an id; rows that agree in id and text are one
document, and rows of one id with different texts are judged each by its own; an empty benchmark leaves all clean; items
with a null id never match; very long texts are processed whole; extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm.common import cut, table, with_row_key, without

WINDOW = 13
#: The word positions that each mask reads.
MASKS = [(0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7)]
REACH = WINDOW - 1
SEEDS = "mask int, hash long, pos int, length int, around binary"
SPLIT = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalnum()), b" " * sum(not chr(b).isalnum() for b in range(128)))


def allowed(window: int) -> int:
    return 2 if window >= 10 else 1 if window >= 8 else 0


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


def word_hashes(texts: list[str | None], cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text starts (one more entry for the end)."""
    words = [(t or "").lower().encode("utf-8", "surrogatepass").translate(SPLIT).split() for t in texts]
    starts = np.cumsum([0, *map(len, words)])
    flat = np.fromiter((cache[w] for ws in words for w in ws), np.uint32, int(starts[-1]))
    return flat, starts


def seed_hashes(words: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """Of every start at which the whole mask fits into `words`."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, salt + 1, np.uint64)
    for o in mask:
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[o : o + n]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def seeds(df: DataFrame, keys: list[str], bits: np.ndarray | None = None) -> DataFrame:
    """Rows (keys, mask, hash, position, words in the text, word hashes from REACH before to REACH after the start of the mask's end).

    `df` has the keys (long) and text. With `bits`, only seeds whose bit is set.
    """
    shared = None if bits is None else df.sparkSession.sparkContext.broadcast(bits)
    shift = 0 if bits is None else 64 - int(np.log2(len(bits) * 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            ids, texts = [batch.column(k) for k in keys], batch.column("text")
            for at in range(0, len(batch), 500):
                flat, starts = word_hashes(texts.slice(at, 500).to_pylist(), cache)
                wide = flat.astype(np.uint64)
                owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                for k, mask in enumerate(MASKS):
                    h = seed_hashes(wide, mask, k)
                    if not len(h):
                        continue
                    ok = owner[: len(h)] == owner[mask[-1] :]
                    if shared is not None:
                        slot = h >> np.uint64(shift)
                        ok &= (shared.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    found = np.flatnonzero(ok)
                    if not len(found):
                        continue
                    doc = owner[found]
                    first, last = starts[doc], starts[doc + 1]
                    low, high = np.maximum(first, found - REACH), np.minimum(last, found + WINDOW)
                    around = [flat[a:b].tobytes() for a, b in zip(low, high, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [*(x.take(pa.array(doc + at)) for x in ids), pa.array(np.full(len(found), k), pa.int32()), pa.array(h[found].view(np.int64)), pa.array(found - first, pa.int32()), pa.array(last - first, pa.int32()), pa.array(around, pa.binary())],
                        [*keys, "mask", "hash", "pos", "length", "around"],
                    )

    return df.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} long" for k in keys) + f", {SEEDS}")


def best_window(a: np.ndarray, a_pos: int, b: np.ndarray, b_pos: int, b_length: int) -> int:
    """Most equal words in a window of the item (b) around the hit, if the window has few enough substitutions, else 0.

    a_pos and b_pos are the index of the seed's start in a and b.
    """
    back, window = min(a_pos, b_pos), min(WINDOW, b_length)
    n = min(len(a) - a_pos, len(b) - b_pos) + back
    if n < window or window < 5:
        return 0
    same = np.cumsum(np.concatenate([[0], a[a_pos - back : a_pos - back + n] == b[b_pos - back : b_pos - back + n]]))
    most = int((same[window:] - same[:-window]).max())
    return most if window - most <= allowed(window) else 0


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in ("around", "pos", "item_around", "item_pos", "item_length")}
        most = []
        for a, ap, b, bp, bl in zip(c["around"], c["pos"], c["item_around"], c["item_pos"], c["item_length"], strict=True):
            most.append(best_window(np.frombuffer(a, np.uint32), min(ap, REACH), np.frombuffer(b, np.uint32), min(bp, REACH), bl))
        keep = pa.array(np.array(most, int) > 0)
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("row_hash"), batch.column("item_id"), pa.array(most, pa.int32()), batch.column("pos")], ["row_id", "row_hash", "item_id", "words", "pos"]).filter(keep)


def filter_bits(test: DataFrame, rows: int) -> np.ndarray:
    """A bit for each value that the highest bits of a test seed's hash take."""
    size = min(28, max(16, int(np.ceil(np.log2(32 * max(1, rows))))))
    slot = F.shiftrightunsigned("hash", 64 - size)
    marked = test.select(slot.alias("slot")).groupBy(F.shiftright("slot", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, CAST(slot & 7 AS INT))) AS bits")).toArrow()
    bits = np.zeros(1 << (size - 3), np.uint8)  # at most that many rows were collected
    bits[marked.column("byte").to_numpy()] = marked.column("bits").to_numpy().astype(np.uint8)
    return bits


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """(row_id, row_hash, item_id, words, pos): the most equal words of a window of the item and the first seed's word position."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    test = cut(seeds(items, ["item_id"]).select("item_id", "mask", "hash", F.col("pos").alias("item_pos"), F.col("length").alias("item_length"), F.col("around").alias("item_around")))
    rows = test.count()
    found = seeds(docs.select(F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_hash"), "text"), ["row_id", "row_hash"], filter_bits(test, rows))
    hits = found.join(F.broadcast(test) if rows <= broadcast_rows else test.hint("merge"), ["mask", "hash"]).select("row_id", "row_hash", "item_id", "pos", "around", "item_pos", "item_length", "item_around")
    if rows <= broadcast_rows:  # few bytes; dealt by place, so that neither a long text nor a frequent seed fills one task
        hits = hits.repartition("row_id", "row_hash", "item_id", "pos", "item_pos")
    checked = hits.mapInArrow(verify, "row_id long, row_hash long, item_id long, words int, pos int")
    return checked.groupBy("row_id", "row_hash", "item_id").agg(F.max("words").alias("words"), F.min("pos").alias("pos"))


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, items (sorted item ids), words (most equal in a window)."""
    by_doc = overlaps(docs, benchmark).groupBy(F.col("row_id").alias("hit_id"), F.col("row_hash").alias("hit_hash")).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("words").alias("words"))
    ids = with_row_key(docs).drop("row")
    return ids.join(by_doc, F.col("row_id").eqNullSafe(F.col("hit_id")) & (F.col("row_hash") == F.col("hit_hash")), "left").select(
        F.col("row_id").alias("doc_id"), F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("words", F.lit(0)).alias("words")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without such an overlap, with all their columns."""
    return without(docs, overlaps(docs, benchmark).select("row_id", "row_hash").distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
