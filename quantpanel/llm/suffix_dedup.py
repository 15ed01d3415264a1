"""Removal of repeated 50-byte passages with suffix arrays built by linear grouping.

A string of `LENGTH` bytes that also starts in a document with a smaller id is removed; all texts are UTF-8 bytes.

1. Every window of `LENGTH` bytes is assigned to an anchor, the 16-byte string in it with the smallest hash (leftmost of
   equal ones). Equal windows have equal anchors at equal distances, so windows that are equal meet at their anchor.
   A text emits one entry for each run of windows with one anchor: hashes of the anchor and of the run's bytes.
2. A shard's task groups entries by anchor. Runs are of one kind if anchor and run agree in 80 bits of hash besides the
   shard's. Where all runs of an anchor are of one kind, every document but the smallest loses the run; no byte moves.
3. Where kinds differ, the bytes of one run of each kind are fetched. Windows whose 64-bit hash stands alone there equal no
   other; the stretches of all other windows, distinct ones once, are decided by the order of suffixes: `suffix_array` sorts
   a chunk of whole groups (Lyndon-prefix groups in descending order, split by previous-smaller pointers, then emitted in
   order), and neighbours in that order with 50 equal bytes are one class, whose smallest document keeps the bytes.
   A group larger than a chunk is sorted as its distinct windows, dealt by their content so that equal ones stay together.
4. The intervals of each document are united and cut out.

So hashes decide what is wholly equal or wholly different, and the suffix order what is equal in part.

Defined cases: null text counts as empty; texts below 50 bytes lose nothing; a null id is smaller than all others; rows of
one id take nothing from each other, null ids included; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm.common import cut, numbered, table, utf8_bytes

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM + 1
LOWEST = -(2**62)
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 2**64)
MASK40 = np.uint64((1 << 40) - 1)
CHUNK = 300_000
#: Entries, requests and pending runs in columns, so that they compress well.
ENTRY = [("hash", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("count", "u1")]
REQUEST = [("doc", "<i8"), ("pos", "<u4"), ("count", "u1"), ("shard", "<i4"), ("kind", "<u4")]
PENDING = [("group", "<u4"), ("kind", "<u4"), ("doc", "<i8"), ("pos", "<u4"), ("count", "u1")]
SPAN = [("doc", "<i8"), ("pos", "<u4"), ("size", "<u2")]


def packed(columns: list[tuple[str, str]], rows: dict[str, np.ndarray]) -> bytes:
    n = len(rows[columns[0][0]])
    out = [np.int64(n).tobytes()]
    for name, kind in columns:
        a = np.ascontiguousarray(rows[name].astype(kind))
        if name in ("doc", "group"):
            a = np.diff(a, prepend=a.dtype.type(0))
        out.append(a.view(np.uint8).reshape(n, -1).T.tobytes() if n else b"")  # byte planes
    return zstandard.compress(b"".join(out), 1)


def unpacked(columns: list[tuple[str, str]], packs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {name: [np.zeros(0, kind)] for name, kind in columns}
    for pack in packs:
        raw = np.frombuffer(zstandard.decompress(pack), np.uint8)
        n, at = int(raw[:8].view(np.int64)[0]), 8
        for name, kind in columns:
            width = np.dtype(kind).itemsize
            a = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel() if n else np.zeros(0, kind)
            parts[name].append(np.cumsum(a, dtype=a.dtype) if name in ("doc", "group") else a)
            at += n * width
    return {name: np.concatenate(x) for name, x in parts.items()}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(np.uint64)) % np.uint64(blocks)).astype(np.int32)


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def runs_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """text (number), pos, count, hash, print of every run of windows with one anchor. Texts are at least LENGTH bytes long."""
    gap = b"\0" * LENGTH
    buf = np.frombuffer(gap.join(texts) + gap, np.uint8)
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes + LENGTH) - sizes - LENGTH
    n = len(buf)
    forward, back = powers(BASE, n + 1), powers(BACK, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[buf] * back[:n], dtype=np.uint64, out=sums[1:])
    starts = np.arange(n - LENGTH + 1)
    gram = mixed((sums[GRAM:] - sums[:-GRAM]) * forward[: n - GRAM + 1])
    # Smallest gram hash, and where, of windows that double in width; the left one wins ties.
    value, place, width = gram, np.arange(len(gram)), 1
    while width < REACH:
        step = min(width, REACH - width)
        left = value[:-step] <= value[step:]
        place = np.where(left, place[:-step], place[step:])
        value = np.where(left, value[:-step], value[step:])
        width += step
    owner = np.repeat(np.arange(len(texts)), sizes + LENGTH)[: len(starts)]
    valid = starts - first[owner] + LENGTH <= sizes[owner]
    place = place[: len(starts)]
    new = valid & np.concatenate([[True], (place[1:] != place[:-1]) | ~valid[:-1] | (owner[1:] != owner[:-1])])
    begin = np.flatnonzero(new)
    run = np.cumsum(new)[valid] - 1
    count = np.bincount(run, minlength=len(begin))
    anchor = place[begin]
    end = begin + count - 1 + LENGTH
    print_ = mixed((sums[end] - sums[begin]) * forward[begin] + (anchor - begin).astype(np.uint64) * np.uint64(BACK) + count.astype(np.uint64))
    return {"text": owner[begin], "pos": begin - first[owner[begin]], "count": count, "hash": gram[anchor], "print": print_}


def suffix_array(text: bytes) -> np.ndarray:
    """Starts of the suffixes of `text` in order.

    Phase 1 keeps suffixes in groups that agree on a Lyndon prefix so far, named by the group's first place in the order.
    Groups are taken from the highest to the lowest; a suffix's previous smaller one is the nearest to its left in a lower
    group, found over the pointers of those already done. Suffixes that are pointed to have the group's prefix behind
    their own: they move to new groups right above their old one, those pointed to more often higher.
    Phase 2 emits: behind every suffix in order come, at the front of their groups, the suffixes whose next smaller suffix
    it is, which are the one before it and the chain of previous smaller ones.
    """
    n = len(text)
    values = np.frombuffer(text, np.uint8)
    counts = np.bincount(values, minlength=256)
    begins = np.cumsum(counts) - counts
    place = begins[values].tolist()
    size = [0] * n
    members: list[list[int] | None] = [None] * n
    by_value = np.argsort(values, kind="stable").tolist()
    for b, c in zip(begins.tolist(), counts.tolist(), strict=True):
        if c:
            size[b], members[b] = c, by_value[b : b + c]
    before = [-1] * n
    for g in range(n - 1, -1, -1):
        listed = members[g]
        if listed is None:
            continue
        pointed: dict[int, int] = {}
        for i in listed:
            if place[i] != g:
                continue  # has moved on
            p = i - 1
            while p >= 0 and place[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        members[g] = None
        if not pointed:
            continue
        often = sorted(set(pointed.values()), reverse=True)
        for k in often:
            moving: dict[int, list[int]] = {}
            for p, m in pointed.items():
                if m == k:
                    moving.setdefault(place[p], []).append(p)
            for old, ps in moving.items():
                rest = size[old] - len(ps)
                if rest:
                    own = old + rest
                    size[old], size[own], members[own] = rest, len(ps), ps
                    for p in ps:
                        place[p] = own
    order, free, done = [-1] * n, list(range(n)), bytearray(n)
    p = n - 1
    for i in range(-1, n):
        if i >= 0:
            p = order[i] - 1
        while p >= 0 and not done[p]:
            g = place[p]
            order[free[g]] = p
            free[g] += 1
            done[p] = 1
            p = before[p]
    return np.array(order)


def smallest_docs(strings: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For every window of each string, the smallest document among the strings that hold an equal window."""
    text = b"".join(strings)
    sizes = np.array([len(s) for s in strings])
    counts = sizes - LENGTH + 1
    first = np.cumsum(sizes) - sizes
    owner = np.full(len(text), -1)
    for k, (a, c) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)):
        owner[a : a + c] = k
    order = suffix_array(text)
    order = order[owner[order] >= 0]
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), LENGTH)
    new = np.concatenate([[True], *[(windows[order[a + 1 : a + 50_001]] != windows[order[a : a + 50_000][: len(order) - 1 - a]]).any(1) for a in range(0, len(order) - 1, 50_000)]])
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[owner[order]], heads)
    low = np.zeros(len(text), np.int64)
    low[order] = least[np.cumsum(new) - 1]
    return [low[a : a + c] for a, c in zip(first.tolist(), counts.tolist(), strict=True)]


def resolve(groups: np.ndarray, strings: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """smallest_docs of all strings; those of a group can be equal in part, and `groups` is sorted.

    A window whose hash stands alone has no equal one. Only stretches of the other windows go to the suffix array, which
    compares their bytes.
    """
    if not strings:
        return []
    buf = np.frombuffer(b"".join(strings), np.uint8)
    n, sizes = len(buf), np.array([len(s) for s in strings])
    counts, first = sizes - LENGTH + 1, np.cumsum(sizes) - sizes
    forward, back = powers(BASE, n), powers(BACK, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[buf] * back, dtype=np.uint64, out=sums[1:])
    owner = np.repeat(np.arange(len(strings)), counts)
    begin = np.cumsum(counts) - counts
    start = np.arange(len(owner)) + (first - begin)[owner]
    _, inverse, seen = np.unique(mixed((sums[start + LENGTH] - sums[start]) * forward[start]), return_inverse=True, return_counts=True)
    often = seen[inverse] > 1
    low = docs[owner]
    edge = np.concatenate([[True], owner[1:] != owner[:-1]])
    new = often & (edge | ~np.concatenate([[False], often[:-1]]))
    at = np.flatnonzero(new)
    length = np.bincount(np.cumsum(new)[often] - 1, minlength=len(at))
    pieces = [buf[a : a + k + LENGTH - 1].tobytes() for a, k in zip(start[at].tolist(), length.tolist(), strict=True)]
    # Equal stretches of a group are sorted once, for the smallest of their documents.
    number: dict[tuple[int, bytes], int] = {}
    which = [number.setdefault(key, len(number)) for key in zip(groups[owner[at]].tolist(), pieces, strict=True)]
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs[owner[at]])
    found = in_chunks(np.array([g for g, _ in number], np.int64), [x for _, x in number], least)
    for a, k, u in zip(at.tolist(), length.tolist(), which, strict=True):
        low[a : a + k] = found[u]
    return np.split(low, begin[1:])


def in_chunks(groups: np.ndarray, strings: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """smallest_docs by group (`groups` is sorted), in chunks of whole groups; a larger group by its single windows."""
    out: list[np.ndarray] = []
    cuts = np.concatenate([np.flatnonzero(np.diff(groups, prepend=-1)), [len(groups)]])
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            out.extend(smallest_docs([strings[i] for i in held], docs[held]))
        held, size = [], 0

    for a, b in zip(cuts, cuts[1:]):
        own = sum(len(strings[i]) for i in range(a, b))
        if size + own > CHUNK:
            flush()
        if own <= CHUNK:
            held += range(a, b)
            size += own
            continue
        singles = [(hash(w), w, i, j) for i in range(a, b) for j in range(len(strings[i]) - LENGTH + 1) for w in [strings[i][j : j + LENGTH]]]
        singles.sort(key=lambda s: s[0])
        lows = [np.zeros(len(strings[i]) - LENGTH + 1, np.int64) for i in range(a, b)]
        at = 0
        while at < len(singles):
            end = min(len(singles), at + CHUNK // LENGTH)
            while end < len(singles) and singles[end][0] == singles[end - 1][0]:
                end += 1
            part = singles[at:end]
            # Equal windows of one batch count once, with their smallest document.
            least: dict[bytes, int] = {}
            for _, w, i, _ in part:
                least[w] = min(least.get(w, int(docs[i])), int(docs[i]))
            found = dict(zip(least, (int(x[0]) for x in smallest_docs(list(least), np.array(list(least.values())))), strict=True))
            for _, w, i, j in part:
                lows[i - a][j] = found[w]
            at = end
        out += lows
    flush()
    return out


def by_block(columns: list[tuple[str, str]], rows: dict[str, np.ndarray], blocks: int) -> tuple[list[int], list[bytes]]:
    block = block_of(rows["doc"], blocks)
    order = np.lexsort((rows["pos"], rows["doc"], block))
    held, first = np.unique(block[order], return_index=True)
    split = {k: np.split(v[order], first[1:]) for k, v in rows.items()}
    return held.tolist(), [packed(columns, {k: split[k][i] for k, _ in columns}) for i in range(len(held))]


def ordered(named: DataFrame, total: int) -> tuple[DataFrame, int]:
    """`named` (doc_id, text) with doc, a number of each row in the order of the ids, and shift: doc >> shift is the id's own.

    Where ids repeat, doc is the first place of the id in the order, then the row's place among those of its id.
    """
    most = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    if most == 1:
        return named.withColumn("doc", F.coalesce("doc_id", F.lit(LOWEST))), 0
    shift = (most - 1).bit_length()
    if total.bit_length() + shift > 62:
        raise ValueError(f"{most} rows of one id among {total} are too many to number")
    rows = numbered(named.withColumns({"all": F.lit(""), "own": F.xxhash64("text")}), ["all"], ["doc_id", "own"])
    first = rows.groupBy("doc_id").agg(F.min("idx").alias("first")).withColumnRenamed("doc_id", "id")
    placed = rows.join(first, F.col("doc_id").eqNullSafe(F.col("id")))
    return cut(placed.select("doc_id", "text", F.shiftleft("first", shift).bitwiseOR(F.col("idx") - F.col("first")).alias("doc"))), shift


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs_per_shard: int = 4_000, docs_per_block: int = 4_000) -> DataFrame:
    """One row per input row: doc_id, text (what is left), n_bytes, n_removed, n_spans, kept_sha256."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = named.count()
    keyed, shift = ordered(named, total)
    shards, blocks = max(8, total // docs_per_shard), max(8, total // docs_per_block)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc"))
            found: list[dict[str, np.ndarray]] = []
            held: list[bytes] = []
            owners: list[int] = []
            size = 0
            texts = [utf8_bytes(t) for t in batch.column("text").to_pylist()]
            for i, t in enumerate([*texts, None]):
                if held and (t is None or size > 1_000_000):
                    r = runs_of(held)
                    r["doc"] = ids[np.array(owners)[r.pop("text")]]
                    found.append(r)
                    held, owners, size = [], [], 0
                if t is not None and len(t) >= LENGTH:
                    held.append(t)
                    owners.append(i)
                    size += len(t)
            if not found:
                continue
            rows = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
            shard = (rows["hash"] % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((rows["doc"], shard))
            held_shards, first = np.unique(shard[order], return_index=True)
            rows["hash"], rows["print"] = rows["hash"] >> np.uint64(24), rows["print"] & MASK40
            split = {k: np.split(v[order], first[1:]) for k, v in rows.items()}
            packs = [packed(ENTRY, {k: split[k][i] for k, _ in ENTRY}) for i in range(len(held_shards))]
            yield pa.RecordBatch.from_arrays([pa.array(held_shards), pa.array(packs, pa.binary())], ["shard", "pack"])

    def group(key: tuple, packs: pa.Table) -> pa.Table:
        """Spans of anchors whose runs are equal; for the others, requests for bytes, and the runs that wait for them."""
        shard = key[0].as_py()
        e = unpacked(ENTRY, packs.column("pack").to_pylist())
        order = np.lexsort((e["pos"], e["doc"], e["print"], e["hash"]))
        e = {k: v[order] for k, v in e.items()}
        new_group = np.concatenate([[True], e["hash"][1:] != e["hash"][:-1]])
        new_kind = new_group | np.concatenate([[True], e["print"][1:] != e["print"][:-1]])
        heads = np.flatnonzero(new_group)
        low, high = np.minimum.reduceat(e["doc"], heads), np.maximum.reduceat(e["doc"], heads)
        kinds = np.add.reduceat(new_kind.astype(int), heads)
        number = np.cumsum(new_group) - 1
        # Numbers of one id differ below `shift` only; rows of one id don't count against each other.
        one = ((kinds == 1) & (low >> shift < high >> shift))[number] & (e["doc"] >> shift > low[number] >> shift)
        several = ((kinds > 1) & (low >> shift < high >> shift))[number]
        kind = np.cumsum(new_kind) - 1
        rep = several & new_kind
        spans = {"doc": e["doc"][one], "pos": e["pos"][one], "size": e["count"][one].astype(int) + LENGTH - 1}
        asked = {"doc": e["doc"][rep], "pos": e["pos"][rep], "count": e["count"][rep], "shard": np.full(rep.sum(), shard), "kind": kind[rep]}
        waiting = {"group": number[several], "kind": kind[several], "doc": e["doc"][several], "pos": e["pos"][several], "count": e["count"][several]}
        out = [("span", *x) for x in zip(*by_block(SPAN, spans, blocks), strict=True)] + [("ask", *x) for x in zip(*by_block(REQUEST, asked, blocks), strict=True)] + [("wait", shard, packed(PENDING, waiting))]
        return pa.table({"what": [x[0] for x in out], "place": pa.array([x[1] for x in out], pa.int32()), "pack": pa.array([x[2] for x in out], pa.binary())})

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            block = block_of(np.asarray(batch.column("doc")), blocks)
            held, packs = np.unique(block), []
            for b in held:
                rows = pa.Table.from_batches([batch]).take(np.flatnonzero(block == b))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=codec) as w:
                    w.write_table(rows)
                packs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(packs, pa.binary())], ["place", "pack"])

    def unpack_texts(packs: pa.Table) -> Iterator[tuple[int, int | None, bytes]]:
        for x in packs.column("pack").to_pylist():
            rows = pa.ipc.open_stream(x).read_all()
            for d, i, t in zip(rows.column("doc").to_pylist(), rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                yield d, i, utf8_bytes(t)

    def fetch(packs: pa.Table, asked: pa.Table) -> pa.Table:
        """The bytes that shards ask for."""
        r = unpacked(REQUEST, asked.column("pack").to_pylist())
        order = np.argsort(r["doc"], kind="stable")
        r = {k: v[order] for k, v in r.items()}
        ends = dict(zip(*(x.tolist() for x in np.unique(r["doc"], return_index=True)), strict=True))
        got: dict[int, tuple[list[int], list[bytes]]] = {}
        for doc, _, text in unpack_texts(packs):
            i = ends.get(doc)
            while i is not None and i < len(order) and r["doc"][i] == doc:
                kinds, parts = got.setdefault(int(r["shard"][i]), ([], []))
                kinds.append(int(r["kind"][i]))
                parts.append(text[int(r["pos"][i]) : int(r["pos"][i]) + int(r["count"][i]) + LENGTH - 1])
                i += 1
        packs_out = [zstandard.compress(np.array([len(k)], np.int64).tobytes() + np.array(k, np.uint32).tobytes() + np.array([len(x) for x in p], np.uint8).tobytes() + b"".join(p)) for k, p in got.values()]
        return pa.table({"place": pa.array(list(got), pa.int32()), "pack": pa.array(packs_out, pa.binary())})

    def decide(waiting: pa.Table, fetched: pa.Table) -> pa.Table:
        """Spans of the runs that waited."""
        w = unpacked(PENDING, waiting.column("pack").to_pylist())
        strings: dict[int, bytes] = {}
        for x in fetched.column("pack").to_pylist():
            raw = zstandard.decompress(x)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            kinds, sizes = np.frombuffer(raw, np.uint32, n, 8), np.frombuffer(raw, np.uint8, n, 8 + 4 * n).astype(int)
            ends = 8 + 5 * n + np.cumsum(sizes)
            strings.update((k, raw[b - s : b]) for k, b, s in zip(kinds.tolist(), ends.tolist(), sizes.tolist(), strict=True))
        heads = np.concatenate([[True], w["kind"][1:] != w["kind"][:-1]]) if len(w["kind"]) else np.zeros(0, bool)
        first = np.flatnonzero(heads)
        lows = resolve(w["group"][first].astype(np.int64), [strings[k] for k in w["kind"][first].tolist()], w["doc"][first])
        docs_, pos, size = [], [], []
        for k, (a, b) in enumerate(zip(first, [*first[1:], len(heads)])):
            low = lows[k]
            for doc, at in zip(w["doc"][a:b].tolist(), w["pos"][a:b].tolist(), strict=True):
                gone = np.flatnonzero(np.diff(np.concatenate([[0], low >> shift < doc >> shift, [0]])))
                for x, y in zip(gone[::2].tolist(), gone[1::2].tolist(), strict=True):
                    docs_.append(doc)
                    pos.append(at + x)
                    size.append(y - x + LENGTH - 1)
        held, packs = by_block(SPAN, {"doc": np.array(docs_, np.int64), "pos": np.array(pos, np.int64), "size": np.array(size, np.int64)}, blocks)
        return pa.table({"place": pa.array(held, pa.int32()), "pack": pa.array(packs, pa.binary())})

    def finish(packs: pa.Table, spans: pa.Table) -> pa.Table:
        s = unpacked(SPAN, spans.column("pack").to_pylist())
        order = np.lexsort((s["pos"], s["doc"]))
        s = {k: v[order] for k, v in s.items()}
        own, at, n = np.unique(s["doc"], return_index=True, return_counts=True)
        where = {d: slice(a, a + c) for d, a, c in zip(own.tolist(), at.tolist(), n.tolist(), strict=True)}
        rows = []
        for doc, doc_id, text in unpack_texts(packs):
            mark = np.zeros(len(text) + 1, np.int32)
            if doc in where:
                a = s["pos"][where[doc]].astype(np.int64)
                np.add.at(mark, a, 1)
                np.add.at(mark, a + s["size"][where[doc]], -1)
            gone = np.cumsum(mark)[:-1] > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
            rows.append((doc_id, kept.decode("utf-8", "replace"), len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())))})

    grouped = cut(keyed.select("doc", "text").mapInArrow(entries, "shard int, pack binary").groupBy("shard").applyInArrow(group, "what string, place int, pack binary"))
    of = lambda what: grouped.where(F.col("what") == what).select("place", "pack")
    texts = keyed.mapInArrow(pack_texts, "place int, pack binary")
    fetched = texts.groupBy("place").cogroup(of("ask").groupBy("place")).applyInArrow(fetch, "place int, pack binary")
    # A fixed number of partitions: the runs are few bytes but much work, and adaptive execution would join them.
    waiting, fetched = of("wait").repartition(shards, "place"), fetched.repartition(shards, "place")
    decided = cut(waiting.groupBy("place").cogroup(fetched.groupBy("place")).applyInArrow(decide, "place int, pack binary"))
    return texts.groupBy("place").cogroup(of("span").union(decided).groupBy("place")).applyInArrow(finish, "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("text")
