"""SimHash near-duplicates found by a generalised pigeonhole.

The 64 bits fall into partitions of correlated bits. Partition i has a threshold t_i with sum(t_i + 1) = distance + 1, so
two fingerprints within the distance agree to t_i bits in at least one partition: no link is missed. The number of
partitions and the thresholds minimise probes plus candidates, estimated by dynamic programming from the distances of a
bounded sample of fingerprints and the number of all. Every fingerprint stands in the bucket of its value in each
partition and probes the buckets within the threshold; candidates of one bucket are compared in blocks, and a bucket
emits links that connect what its links connect, never all pairs of a group.

Equal fingerprints are one class before anything is probed; only class members move with the final join.

`near_duplicates` links fingerprints alone. `verified_duplicates` takes a wider distance and confirms candidates by the
Jaccard similarity of the shingle sets: all of them, but for those whose ends are connected already.

Defined cases: null text counts as empty; a text without words has fingerprint zero and is linked like any other; a text
of fewer words than a shingle is one shingle; null ids never become component ids unless a class has no other; repeated
rows get a row each; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm.common import cut, table, utf8_bytes, with_row_key, without
from quantpanel.llm.components import components

BITS = 64


def shingles(text: str | None, size: int) -> list[bytes]:
    words = utf8_bytes(text).lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -size]])
    return [line[a:b] for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]


def hashes(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in parts]), ">u8")


def majority(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: str | None, size: int, distinct: bool = False) -> int:
    """The majority of the shingles' hash bits; with `distinct`, a repeated shingle counts once."""
    h = hashes(shingles(text, size))
    return majority(np.unique(h) if distinct else h)


#: Rows of a batch that are Python strings at one time.
SLICE = 500


def fingerprints(docs: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """(keys, fp) of every row of `docs` (keys: long, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                fp = np.array([fingerprint(t, size) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*map(part.column, keys), pa.array(fp.view(np.int64))], [*keys, "fp"])

    return docs.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", fp long")


SKETCH = 1024


def grams_of(h: np.ndarray) -> np.ndarray:
    """The sorted distinct 32-bit shingle hashes of a text."""
    return np.unique(h.astype(np.uint64).astype(np.uint32))


def sketch_of(grams: np.ndarray) -> bytes:
    """SKETCH bits: how often each residue occurs, odd or even. Two sketches differ in no more bits than their sets in members."""
    return np.packbits((np.bincount(grams & np.uint32(SKETCH - 1), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def sketches(docs: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """(keys, fp, n, sketch): the fingerprint of the distinct shingles, their number and their sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                held = [hashes(shingles(t, size)) for t in part.column("text").to_pylist()]
                fp, sets = np.array([majority(np.unique(h)) for h in held], np.uint64), [grams_of(h) for h in held]
                yield pa.RecordBatch.from_arrays([*map(part.column, keys), pa.array(fp.view(np.int64)), pa.array([len(g) for g in sets], pa.int32()), pa.array([sketch_of(g) for g in sets], pa.binary())], [*keys, "fp", "n", "sketch"])

    return docs.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", fp long, n int, sketch binary")


def bits_of(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, SKETCH // 64)


def possible(n_a: np.ndarray, n_b: np.ndarray, odd_a: np.ndarray, odd_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes and sketches can be that similar; never false for sets that are.

    |a ^ b| = |a| + |b| - 2 |a & b|, so sketches of similar sets differ in few bits.
    """
    apart = np.bitwise_count(odd_a ^ odd_b).sum(1, dtype=np.int64)
    return (apart <= (n_a + n_b) * (1 - similarity) / (1 + similarity) + 1e-6) & (np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b) - 1e-6)


@dataclass
class Plan:
    parts: list[list[int]]  # bit positions
    thresholds: list[int]  # -1: the partition isn't used
    cost: float


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size; each takes the bits most correlated with those it has."""
    left, parts = set(range(BITS)), []
    for i in range(m):
        want = len(left) // (m - i)
        part = [max(left, key=lambda b: (max((corr[b, c] for c in left if c != b), default=0), -b))]
        left.discard(part[0])
        while len(part) < want:
            b = max(left, key=lambda b: (corr[b, part].mean(), -b))
            part.append(b)
            left.discard(b)
        parts.append(sorted(part))
    return parts


def plan(sample: np.ndarray, total: int, distance: int, probe_cost: float = 50.0) -> Plan:
    """The cheapest partitions and thresholds for `total` fingerprints; a probe costs as much as `probe_cost` comparisons."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(float) if len(sample) else np.zeros((0, BITS))
    signs, total = bits * 2 - 1, max(1, total)
    corr = np.abs(signs.T @ signs) / max(1, len(sample))
    best = None
    for m in range(2, 9):
        parts = group_bits(corr, m)
        costs = []
        for part in parts:
            b = len(part)
            own = signs[:, part]
            far = ((b - own @ own.T) / 2)[np.triu_indices(len(sample), 1)].round().astype(int)
            seen = np.cumsum(np.bincount(far, minlength=b + 1)) / max(1, len(far))
            ideal = np.cumsum([comb(b, t) for t in range(b + 1)]) / 2.0**b
            probes = np.cumsum([comb(b, t) for t in range(b + 1)])
            costs.append([0.0] + [total * probes[t] * probe_cost + total**2 / 2 * max(seen[t], ideal[t]) for t in range(min(b, distance) + 1)])
        # table[s]: least cost and thresholds so far with sum(t_i + 1) = s
        cells = {0: (0.0, [])}
        for cost in costs:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in cells.items():
                for t1, extra in enumerate(cost):
                    if s + t1 <= distance + 1 and (s + t1 not in nxt or c + extra < nxt[s + t1][0]):
                        nxt[s + t1] = (c + extra, [*chosen, t1 - 1])
            cells = nxt
        if distance + 1 in cells and (best is None or cells[distance + 1][0] < best.cost):
            best = Plan(parts, cells[distance + 1][1], cells[distance + 1][0])
    return best


def part_values(fp: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for i, b in enumerate(part):
        out |= ((fp >> np.uint64(BITS - 1 - b)) & np.uint64(1)).astype(np.int64) << i
    return out


def within(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.int64)


def bucket_rows(spots: DataFrame, p: Plan) -> DataFrame:
    """(key, spot columns, home): each spot's own bucket of each partition (home) and those it probes. All columns are long."""
    names = spots.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [within(len(part), t) if t >= 0 else None for part, t in zip(p.parts, p.thresholds, strict=True)]
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                columns = {n: batch.column(n)[at : at + 2_000].to_numpy() for n in names}
                for i, (part, mask) in enumerate(zip(p.parts, masks, strict=True)):
                    if mask is None:
                        continue
                    key = (part_values(columns["fp"].view(np.uint64), part)[:, None] ^ mask[None, :]) | (i << 48)
                    home = np.zeros(key.shape, bool)
                    home[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(pa.array(np.repeat(columns[n], len(mask))) for n in names), pa.array(home.ravel())], ["key", *names, "home"])

    return spots.mapInArrow(run, f"key long, {', '.join(f'{n} long' for n in names)}, home boolean")


#: Comparisons that one task makes for one bucket.
TILE = 200_000_000


def tiled(rows: DataFrame, tile: int | None = None) -> DataFrame:
    """`rows` of buckets (key, fp, home) with tile and probe, each tile of a bucket to one task and sorted.

    A bucket of more than `tile` comparisons is a grid of tiles: its home rows are dealt over the lines and stand in every
    column, its probes over the columns and stand in every line. So each probe meets each home row once, in tasks of
    bounded size, however many fingerprints share the bucket.
    """
    tile = tile or TILE
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    large = sizes.where(F.col("n") * F.col("homes") > tile).select("key", F.ceil(F.sqrt(F.col("n") * F.col("homes") / tile)).cast("int").alias("grid"))
    if large.isEmpty():
        dealt = rows.withColumn("tile", F.lit(0)).withColumn("probe", F.lit(True))
    else:
        spots = [c for c in rows.columns if c not in ("key", "home")]
        own = [c for c in spots if c in ("fp", "grp", "node")]
        line, column = F.pmod(F.xxhash64(*own), F.col("grid")).cast("int"), F.pmod(F.xxhash64(*own, F.lit(1)), F.col("grid")).cast("int")
        each = F.sequence(F.lit(0), F.col("grid") - 1)
        place = lambda at, home, probe: F.struct(at.alias("tile"), F.lit(home).alias("home"), F.lit(probe).alias("probe"))
        places = F.concat(F.when(F.col("home"), F.transform(each, lambda j: place(line * F.col("grid") + j, True, False))).otherwise(F.slice(F.transform(each, lambda j: place(j, True, False)), 1, 0)), F.transform(each, lambda i: place(i * F.col("grid") + column, False, True)))
        alone = F.array(F.struct(F.lit(0).alias("tile"), F.col("home").alias("home"), F.lit(True).alias("probe")))
        dealt = rows.join(large, "key", "left").withColumn("at", F.explode(F.when(F.col("grid").isNull(), alone).otherwise(places))).select("key", *spots, "at.*")
    return dealt.repartition("key", "tile").sortWithinPartitions("key", "tile")


def local_links(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links between u[i] and v[i]: fewer links that connect the same."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def compare(home: np.ndarray, probes: np.ndarray, distance: int, nearest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket, in blocks of a million comparisons; with `nearest`, that many closest of the smaller partners of a probe.

    A pair is met from its larger side there, so it isn't found a second time from the other.
    """
    us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    step = max(1, 1_000_000 // max(1, len(home)))
    for at in range(0, len(probes), step):
        block = probes[at : at + step]
        far = np.bitwise_count(block[:, None] ^ home[None, :])
        near = (far <= distance) & (block[:, None] != home[None, :] if nearest is None else block[:, None] > home[None, :])
        if nearest is not None and len(home) > nearest:
            # That many and no more, also of equally close ones: the others are left to the second round.
            chosen = np.argpartition(np.where(near, far, 99), nearest - 1, axis=1)[:, :nearest]
            first = np.zeros_like(near)
            np.put_along_axis(first, chosen, True, axis=1)
            near &= first
        i, j = np.nonzero(near)
        if nearest is None and len(i):
            u, v = local_links(block[i], home[j])
            us.append(u)
            vs.append(v)
        elif len(i):
            us.append(block[i])
            vs.append(home[j])
    u, v = np.concatenate(us), np.concatenate(vs)
    return local_links(u, v) if nearest is None and len(u) else (u, v)


def links(classes: DataFrame, p: Plan, distance: int, nearest: int | None = None, tile: int | None = None) -> DataFrame:
    """(u, v): linked fingerprints. Without `nearest` they connect exactly what all links within the distance connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list) -> pa.RecordBatch:
            u, v = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            pairs = np.unique(np.stack([u, v], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["u", "v"])

        found, held = [], 0
        for _, _, fp, home, probe in by_bucket(batches, ["key", "tile", "fp", "home", "probe"]):
            if len(fp) > 1 and home.any():
                fp = fp.view(np.uint64)
                f = compare(fp[home], fp[probe], distance, nearest)
                if len(f[0]):
                    found.append(f)
                    held += len(f[0])
            if held > 200_000:
                yield out(found)
                found, held = [], 0
        if found:
            yield out(found)

    return tiled(bucket_rows(classes.select("fp"), p), tile).mapInArrow(run, "u long, v long").distinct()


def sampled_plan(classes: DataFrame, distance: int, sample: int = 1_500) -> Plan:
    total = classes.count()
    picked = classes.select("fp").orderBy(F.xxhash64("fp")).limit(sample).toArrow().column("fp").to_numpy()  # `sample` numbers
    return plan(picked.view(np.uint64), total, distance)


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3, tile: int | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hexadecimal), component_id."""
    fps = cut(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size, ["doc_id"]))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(classes, sampled_plan(classes, distance), distance, tile=tile))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, grams) of `nodes` (row_id, row_hash, node): the sorted distinct 32-bit shingle hashes of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                grams = [grams_of(hashes(shingles(t, size))).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(grams, pa.binary())], ["node", "grams"])

    wanted = nodes.select(F.col("row_id").alias("node_id"), F.col("row_hash").alias("node_hash"), "node")
    texts = docs.select("row_id", "row_hash", "text").join(wanted, F.col("row_id").eqNullSafe(F.col("node_id")) & (F.col("row_hash") == F.col("node_hash")))
    return texts.select("node", "text").mapInArrow(run, "node long, grams binary").dropDuplicates(["node"])  # repeated rows


def near_others(p: Plan, i: int, probe: tuple[np.ndarray, np.ndarray], home: tuple[np.ndarray, np.ndarray], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in `probe`, in `home`) of the candidates of one bucket of partition i, in blocks of a million comparisons.

    Both sides are fingerprints and groups. Candidates lie within the distance and in different groups; of all buckets
    where a pair meets only the one of its first partition has it, and only from its larger side.
    """
    (fp_p, group_p), (fp_h, group_h) = probe, home
    masks = [(np.uint64(sum(1 << (BITS - 1 - b) for b in part)), t) for part, t in zip(p.parts[:i], p.thresholds[:i], strict=True) if t >= 0]
    step = max(1, 1_000_000 // max(1, len(fp_h)))
    for at in range(0, len(fp_p), step):
        f, g = fp_p[at : at + step, None], group_p[at : at + step, None]
        x, y = np.nonzero((np.bitwise_count(f ^ fp_h) <= distance) & ((f > fp_h) | ((f == fp_h) & (g > group_h))) & (g != group_h))
        x += at
        differ = fp_p[x] ^ fp_h[y]
        first = np.ones(len(x), bool)
        for mask, t in masks:
            first &= np.bitwise_count(differ & mask) > t
        yield x[first], y[first]


def by_bucket(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket's tile, of batches that are sorted by the first two of them (key and tile)."""
    rest: list[list[np.ndarray]] = []

    def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]

    for batch in batches:
        if not len(batch):
            continue
        got = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if rest and (got[0][0] != rest[-1][0][-1] or got[1][0] != rest[-1][1][-1]):
            yield joined(rest)
            rest = []
        edges = np.concatenate([[0], np.flatnonzero((np.diff(got[0]) != 0) | (np.diff(got[1]) != 0)) + 1])
        if len(edges) > 1:
            yield joined([*rest, [x[: edges[1]] for x in got]])
            rest = []
            for a, b in zip(edges[1:], edges[2:]):
                yield [x[a:b] for x in got]
        rest.append([x[edges[-1] :] for x in got])
    if rest:
        yield joined(rest)


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def remaining_links(docs: DataFrame, members: DataFrame, p: Plan, size: int, similarity: float, distance: int, tile: int | None = None) -> DataFrame:
    """(u, v): verified links that connect what all verified candidates of different groups connect.

    `members` has row_id, row_hash, node, fp, grp, n, sketch. First the spots of buckets that have a candidate of another
    group are found, then, by sketches, the documents of them that can be similar to one; only they fetch their shingle
    sets. Then every candidate of a tile is verified whose groups no link of that tile has connected yet: no pair is
    written anywhere, and none is left out.
    """

    def marked(names: list[str], schema: str, used_rows) -> tuple:
        """A function that keeps the rows of tiles that `used_rows` marks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, held = [], 0
            flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
            for columns in by_bucket(batches, ["key", "tile", *names[1:], "probe", *extra]):
                row = dict(zip(["key", "tile", *names[1:], "probe", *extra], columns, strict=True))
                if len(row["key"]) < 2 or not row["home"].any():
                    continue
                used = used_rows(row)
                if used.any():
                    out.append([row[n][used] for n in names])
                    held += len(out[-1][0])
                if held > 50_000:
                    yield flush()
                    out, held = [], 0
            if out:
                yield flush()

        extra = ["n", "sketch"] if "node" in names else []
        return run, schema

    def candidates(row: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at_home, at_probe, f = np.flatnonzero(row["home"]), np.flatnonzero(row["probe"]), row["fp"].view(np.uint64)
        for x, y in near_others(p, int(row["key"][0]) >> 48, (f[at_probe], row["grp"][at_probe]), (f[at_home], row["grp"][at_home]), distance):
            yield at_probe[x], at_home[y]

    def by_distance(row: dict[str, np.ndarray]) -> np.ndarray:
        used = np.zeros(len(row["key"]), bool)
        for x, y in candidates(row):
            used[x] = used[y] = True
        return used

    def by_sketch(row: dict[str, np.ndarray]) -> np.ndarray:
        used, n, odd = np.zeros(len(row["key"]), bool), row["n"].astype(np.int64), bits_of(row["sketch"].tolist())
        for x, y in candidates(row):
            for at in range(0, len(x), 50_000):
                a, b = x[at : at + 50_000], y[at : at + 50_000]
                may = possible(n[a], n[b], odd[a], odd[b], similarity)
                used[a[may]] = used[b[may]] = True
        return used

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "tile", "fp", "grp", "home", "probe", "node", "grams"]
        for columns in by_bucket(batches, names):
            row = dict(zip(names, columns, strict=True))
            sets, grp, node = [np.frombuffer(g, np.uint32) for g in row["grams"]], row["grp"], row["node"]
            n, odd = np.array([len(s) for s in sets]), bits_of([sketch_of(s) for s in sets])
            above: dict[int, int] = {}

            def root(g: int) -> int:
                while g in above:
                    above[g] = above.get(above[g], above[g])
                    g = above[g]
                return g

            us, vs = [], []
            for x, y in candidates(row):
                for at in range(0, len(x), 50_000):
                    a, b = x[at : at + 50_000], y[at : at + 50_000]
                    may = possible(n[a], n[b], odd[a], odd[b], similarity)
                    for i, j in zip(a[may].tolist(), b[may].tolist(), strict=True):
                        ra, rb = root(int(grp[i])), root(int(grp[j]))
                        if ra != rb and similar(sets[i], sets[j], similarity):
                            above[ra] = rb
                            us.append(int(node[i]))
                            vs.append(int(node[j]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    spots = members.select("fp", "grp").distinct()
    # A spot that was used in one tile of a bucket is used in all; one that is needed at home was used there.
    met = tiled(bucket_rows(spots, p), tile).mapInArrow(*marked(["key", "fp", "grp", "home"], "key long, fp long, grp long, home boolean", by_distance))
    met = cut(met.groupBy("key", "fp", "grp").agg(F.max("home").alias("home")))
    sketched = met.join(members.select("fp", "grp", "node", "n", "sketch"), ["fp", "grp"])
    near = tiled(sketched.select("key", "fp", "grp", "home", "node", "n", "sketch"), tile).mapInArrow(*marked(["key", "fp", "grp", "home", "node"], "key long, fp long, grp long, home boolean, node long", by_sketch))
    near = cut(near.groupBy("key", "fp", "grp", "node").agg(F.max("home").alias("home")))
    sets = cut(shingle_sets(docs, members.join(near.select("node").distinct(), "node", "left_semi"), size))
    full = near.join(sets, "node").select("key", "fp", "grp", "home", "node", "grams")
    return tiled(full, tile).mapInArrow(verify, "u long, v long")


def verified_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, distance: int = 14, nearest: int = 1, tile: int | None = None) -> DataFrame:
    """(row_id, row_hash, keep_id, kept) of the documents in a group of two or more; keep_id is the id of the one that stays.

    Rows are told apart as in `with_row_key`. The smallest id stays, a null one only if the group has no other; of equal
    ids (with different texts) the one with the smallest text hash.

    Fingerprints count distinct shingles, as the similarity does: a line repeated in one copy doesn't move it away.
    Links are the pairs within the distance whose shingle sets have the similarity. The first round verifies the `nearest`
    closest fingerprints in each bucket and the first document of an equal fingerprint, which connects most of what
    belongs together; the second verifies all other candidates whose ends the first left in different groups, every document
    of an equal fingerprint among them. So `nearest` decides what is verified first, not what is verified.
    """
    docs = with_row_key(docs).select("row_id", "row_hash", F.col("row.text").alias("text"))
    fps = sketches(docs, size, ["row_id", "row_hash"]).dropDuplicates(["row_id", "row_hash"])
    # Numbers are given once, in the job that writes them.
    fps = cut(fps.withColumn("node", F.monotonically_increasing_id()))
    classes = cut(fps.groupBy("fp").agg(F.min("node").alias("rep")))
    p = sampled_plan(classes, distance)
    near = links(classes, p, distance, nearest, tile)
    reps = classes.select("fp", "rep")
    pairs = near.join(reps.select(F.col("fp").alias("u"), F.col("rep").alias("a")), "u").join(reps.select(F.col("fp").alias("v"), F.col("rep").alias("b")), "v").select("a", "b")
    same = fps.join(reps, "fp").where(F.col("node") != F.col("rep")).select(F.col("node").alias("a"), F.col("rep").alias("b"))

    def can_be_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("na", "nb", "sa", "sb")}
            may = possible(c["na"].astype(np.int64), c["nb"].astype(np.int64), bits_of(c["sa"].tolist()), bits_of(c["sb"].tolist()), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(may))

    # Sketches rule most candidates out before any text is read again.
    of = lambda side: fps.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
    pairs = cut(pairs.union(same).join(of("a"), "a").join(of("b"), "b").mapInArrow(can_be_similar, "a long, b long"))
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = cut(shingle_sets(docs, fps.join(involved, "node", "left_semi"), size))

    def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity) for x, y in zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    sided = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    found = cut(components(sided.select("a", "b", "ga", "gb").mapInArrow(jaccard, "u long, v long")))
    members = cut(fps.join(found.withColumnRenamed("root", "grp"), "node", "left").select("row_id", "row_hash", "node", "fp", "n", "sketch", F.coalesce("grp", "node").alias("grp")))
    rest = remaining_links(docs, members, p, size, similarity, distance, tile)
    grouped = cut(fps.join(components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(rest)), "node").select("row_id", "row_hash", "root"))
    key = F.struct(F.col("row_id").isNull().alias("none"), "row_id", "row_hash")
    first = grouped.groupBy("root").agg(F.min(key).alias("first"))
    return grouped.join(first, "root").select("row_id", "row_hash", F.col("first.row_id").alias("keep_id"), (key == F.col("first")).alias("kept"))


def keep_one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, distance: int = 14, tile: int | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one document of each group of near duplicates."""
    return without(docs, verified_duplicates(docs, size, similarity, distance, tile=tile).where(~F.col("kept")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
