"""Line deduplication with a sharded minimal perfect hash.

A line's key is the line stripped of white space and lower-cased (A-Z). Keys of at least `min_chars` code points found in
at least `min_docs` documents lose all their lines except in the document with the largest id.

1. Texts emit, for each shard of the hash space, one packed row a batch: key hashes and document ids.
2. Each batch is summed by key before the shuffle, so a line that a third of all documents share sends one entry a batch.
   A shard's task adds them up. Keys in too few documents can drop no line; over the distinct hashes of the others it builds
   a minimal perfect hash, and stores at a hash's index the hash, a 64-bit fingerprint, the document count and the largest
   id: an array of 32-byte cells. A task holds the keys of its shard, some 100,000 rows of documents by default.
3. The packed rows of step 1 meet the arrays of their shard and probe them; a shard is dealt to as many tasks as its
   entries fill, so one that holds a line of a third of all documents takes many. What is dropped comes back as
   (document, key hashes). No line text is joined.

Defined cases: null and empty texts are one empty line; every row counts as a document of its own, also where ids repeat
(its lines go by its id: all rows with the largest id keep theirs); a null id is smaller than all others; an empty table
gives an empty result; very long texts are processed whole; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm.common import SPACES, cut, table

LOWEST = -(2**63)
ENTRY = np.dtype([("hash", "<u8"), ("print", "<u8"), ("doc", "<i8")])
COUNT = np.dtype([("hash", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("docs", "<i8")])


def key_digest(line: str, min_chars: int) -> bytes | None:
    """128 bits of the key's hash, or None for a key that is too short to count."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACES)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None


def mixed(h: np.ndarray, level: int) -> np.ndarray:
    h = (h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(16)


class PerfectHash:
    """Levels of bits: a hash that is alone in its slot sets the bit, the others go on to the next level.

    The index of a hash is the number of bits set before its own, so indexes run from 0 to n - 1 without gaps.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits, most significant first
        sizes = [np.concatenate([[0], np.cumsum(np.bitwise_count(x), dtype=np.int64)]) for x in levels]
        self.before, base = [], 0
        for s in sizes:
            self.before.append(s + base)
            base += s[-1]

    @classmethod
    def build(cls, hashes: np.ndarray, spread: float = 2.0) -> PerfectHash:
        levels, left = [], np.unique(hashes)
        while len(left):
            size = max(64, int(spread * len(left)) + 7 >> 3 << 3)
            slot = mixed(left, len(levels)) % np.uint64(size)
            alone = np.bincount(slot.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone))
            left = left[~alone[slot]]
        return cls(levels)

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's index; of a hash that wasn't built in, any index or -1."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, bits in enumerate(self.levels):
            slot = (mixed(hashes[left], level) % np.uint64(len(bits) * 8)).astype(np.int64)
            byte, bit = bits[slot >> 3], (slot & 7).astype(np.uint8)
            hit = (byte >> (7 - bit)) & 1 == 1
            rank = np.bitwise_count(byte.astype(np.uint16) >> (8 - bit.astype(np.uint16)))
            out[left[hit]] = self.before[level][slot[hit] >> 3] + rank[hit]
            left = left[~hit]
        return out


def summed(entries: np.ndarray) -> np.ndarray:
    """COUNT rows with distinct (hash, print): documents added up, largest id."""
    order = np.lexsort((entries["print"], entries["hash"]))
    e = entries[order]
    new = np.concatenate([[True], (e["hash"][1:] != e["hash"][:-1]) | (e["print"][1:] != e["print"][:-1])])
    first = np.flatnonzero(new)
    out = np.zeros(len(first), COUNT)
    out["hash"], out["print"] = e["hash"][first], e["print"][first]
    out["doc"] = np.maximum.reduceat(e["doc"], first)
    out["docs"] = np.add.reduceat(e["docs"], first)
    return out


def packed_keys(docs: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """(shard, salt, entries): packed ENTRY rows, one for each distinct key of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            digests, owners = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = {d for line in (text or "").split("\n") if (d := key_digest(line, min_chars))}
                digests += found
                owners += [LOWEST if doc is None else doc] * len(found)
            if not digests:
                continue
            e = np.zeros(len(owners), ENTRY)
            both = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)
            e["hash"], e["print"], e["doc"] = both[:, 0], both[:, 1], owners
            shard = (e["hash"] % np.uint64(shards)).astype(np.int32)
            e = e[order := np.argsort(shard, kind="stable")]
            held, first = np.unique(shard[order], return_index=True)
            salt = int(xxhash.xxh32_intdigest(digests[0], n) & 0x7FFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([salt] * len(held), pa.int32()), pa.array([x.tobytes() for x in np.split(e, first[1:])], pa.binary())], ["shard", "salt", "entries"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "shard int, salt int, entries binary")


def shard_arrays(packed: DataFrame, min_docs: int) -> DataFrame:
    """(shard, levels, cells): the perfect hash of each shard and, by its index, packed COUNT cells."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                e = np.frombuffer(raw, ENTRY)
                c = np.ones(len(e), COUNT)
                c["hash"], c["print"], c["doc"] = e["hash"], e["print"], e["doc"]
                held.setdefault(shard, []).append(c)
                size += c.nbytes
            if size > 64_000_000:
                yield out(held)
                held, size = {}, 0
        if held:
            yield out(held)

    def out(held: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([summed(np.concatenate(x)).tobytes() for x in held.values()], pa.binary())], ["shard", "counts"])

    def build(key: tuple, group: pa.Table) -> pa.Table:
        counts = summed(np.concatenate([np.frombuffer(x, COUNT) for x in group.column("counts").to_pylist()]))
        often = counts[counts["docs"] >= min_docs]
        perfect = PerfectHash.build(often["hash"])
        # Of two keys with one 64-bit hash (and different prints) the table holds one cell each, behind one another.
        at = perfect.index(often["hash"])
        order = np.argsort(at, kind="stable")
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([[x.tobytes() for x in perfect.levels]], pa.list_(pa.binary())), "cells": pa.array([often[order].tobytes()], pa.binary())})

    return packed.select("shard", "entries").mapInArrow(sums, "shard int, counts binary").groupBy("shard").applyInArrow(build, "shard int, levels array<binary>, cells binary")


def probe(entries: np.ndarray, levels: list[bytes], cells: np.ndarray) -> np.ndarray:
    """The entries whose lines go."""
    if not len(cells):
        return entries[:0]
    perfect = PerfectHash([np.frombuffer(x, np.uint8) for x in levels])
    n = int(perfect.before[-1][-1])
    first = np.searchsorted(perfect.index(cells["hash"]), np.arange(n))  # the identity but for chained cells
    at = perfect.index(entries["hash"])
    gone = np.zeros(len(entries), bool)
    known = np.flatnonzero(at >= 0)
    cell = first[at[known]]
    while len(known):
        same = cells["print"][cell] == entries["print"][known]
        same &= cells["hash"][cell] == entries["hash"][known]
        gone[known[same]] = entries["doc"][known[same]] != cells["doc"][cell[same]]
        nxt = cell + 1
        on = ~same & (nxt < len(cells)) & (cells["hash"][np.minimum(nxt, len(cells) - 1)] == entries["hash"][known])
        known, cell = known[on], nxt[on]
    return entries[gone]


def dropped_keys(docs: DataFrame, min_chars: int, min_docs: int, shards: int, task_bytes: int) -> DataFrame:
    """(doc_id, gone): the packed 128-bit key hashes that a document loses, one row for each shard that has some."""
    packed = cut(packed_keys(docs, shards, min_chars))
    arrays = cut(shard_arrays(packed, min_docs))

    def answer(key: tuple, requests: pa.Table, cells: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("gone", pa.binary())])
        if not requests.num_rows or not cells.num_rows:
            return schema.empty_table()
        entries = np.concatenate([np.frombuffer(x, ENTRY) for x in requests.column("entries").to_pylist()])
        gone = probe(entries, cells.column("levels")[0].as_py(), np.frombuffer(cells.column("cells")[0].as_py(), COUNT))
        if not len(gone):
            return schema.empty_table()
        gone = gone[np.argsort(gone["doc"], kind="stable")]
        doc, first = np.unique(gone["doc"], return_index=True)
        digests = np.stack([gone["hash"], gone["print"]], 1).astype(">u8")
        return pa.table([pa.array(doc), pa.array([x.tobytes() for x in np.split(digests, first[1:])], pa.binary())], schema=schema)

    # A row for each shard, and there are as many shards as the documents ask for, some 100,000 documents each.
    salts = F.broadcast(packed.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("entries")) / task_bytes).cast("int").alias("salts")))
    dealt = packed.join(salts, "shard").select("shard", F.pmod("salt", F.col("salts")).alias("salt"), "entries").groupBy("shard", "salt")
    copies = arrays.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("shard", "salt", "levels", "cells").groupBy("shard", "salt")
    return dealt.cogroup(copies).applyInArrow(answer, "doc_id long, gone binary")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shards: int | None = None, task_bytes: int = 4_000_000) -> DataFrame:
    """One row per input row: doc_id, text (the remaining lines), n_lines, n_dropped, kept_sha256. A shard has some 100,000 rows of documents by default."""
    shards = shards or max(8, docs.count() // 100_000)
    gone = dropped_keys(docs, min_chars, min_docs, shards, task_bytes).groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_list("gone").alias("gone"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, lost, sha = [], [], [], []
            for text, packs in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                text = text or ""
                n = text.count("\n") + 1
                kept = text
                total.append(n)
                if packs:
                    bad = {p[i : i + 16] for p in packs for i in range(0, len(p), 16)}
                    lines = [x for x in text.split("\n") if key_digest(x, min_chars) not in bad]
                    kept, n = "\n".join(lines), n - len(lines)
                    lost.append(n)
                else:
                    lost.append(0)
                texts.append(kept)
                sha.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = ids.join(gone, F.coalesce("doc_id", F.lit(LOWEST)) == F.col("gone_id"), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(rest, "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("text")


SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, text FROM documents
), lines AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM rows
), keyed AS (
  SELECT rid, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5
), marked AS (
  SELECT rid, keyed.doc_id, line, pos, often.key IS NOT NULL AND keyed.doc_id IS DISTINCT FROM last_doc AS gone FROM keyed LEFT JOIN often USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
