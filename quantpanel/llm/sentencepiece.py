"""SentencePiece encoding and decoding as a relational lattice.

1. Texts are dealt into blocks of some megabytes. A block's words are cut where no piece can reach across (checked against
   the vocabulary); spaces and U+2581 are one character, and one is put in front. Words are slices of the block's bytes.
2. Blocks ask for their distinct words, each word at one part of the hash space, so a word is encoded once for the corpus.
3. Lattice: every word's substrings of at most the longest piece are exploded and joined to the piece table, which is
   broadcast (its size is the vocabulary's, checked); the edges are grouped by word.
4. Fold: a higher-order aggregate folds the edges of a word. For unigram models it is Viterbi: the best path to each end.
   BPE models have no path score (the sum of their scores gives other ids than the library), so there the fold takes the
   edges from the best rank to the worst and merges what each joins, which is what BPE does; a long holds the token
   borders. An edge that can't merge yet waits, and is tried again after each later merge. Both equal the library's ids.
   Words above `MOST` characters, too long for a 64-bit border set, get their ids from `long_word` by the same rules.
5. Each part answers the blocks with the ids in the order asked for, and blocks put their texts' ids together.

Characters outside the vocabulary become byte pieces. Decoding joins the pieces and drops the space in front.

Defined cases: null and empty texts have no ids and decode to the empty text; U+2581 in a text decodes to a space, as in
the library; repeated rows and ids get a row each; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MOST = 60
#: Latin letters stand in words of their own, all other characters up to the next space or line in others.
LATIN = "a-zA-ZÀ-ÖØ-öø-ɏ"
WORDS = re.compile(f" *[{LATIN}]+| *[^ \n{LATIN}]+| +|\n")
#: The classes of a character.
OTHER, LETTER, BLANK, LINE = 0, 1, 2, 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    kind: str  # "bpe" or "unigram"
    pieces: list[tuple[str, int, float]]  # text (with spaces), id, score; without control and byte pieces
    byte_ids: list[int]
    names: list[bytes]  # by id, what it decodes to
    longest: int

    @property
    def unknown_score(self) -> float:
        return min(s for _, _, s in self.pieces) - 10.0

    def ranks(self) -> dict[float, int]:
        """1 for the best score; equal scores share a rank."""
        return {s: r for r, s in enumerate(sorted({s for _, _, s in self.pieces}, reverse=True), 1)}


def load(path: str = MODEL, kind: str = "bpe") -> Pieces:
    """The vocabulary of a model file. The file must have byte pieces, an identity normaliser and no piece over a cut of WORDS."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found, byte_ids, names = [], [0] * 256, []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            names.append(bytes([int(text[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            names.append(b"")
        else:
            found.append((text.replace(SPACE, " "), i, model.get_score(i)))
            names.append(text.replace(SPACE, " ").encode())
    bad = [t for t, _, _ in found if WORDS.fullmatch(t) is None]
    if bad:
        raise ValueError(f"pieces reach across words: {bad[:5]}")
    return Pieces(kind, found, byte_ids, names, max(len(t) for t, _, _ in found))


def classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 text belongs to."""
    table_ = np.full(256, OTHER, np.uint8)
    table_[[*range(65, 91), *range(97, 123), *range(0xC4, 0xC9)]] = LETTER  # U+0100 to U+023F have these lead bytes
    table_[32], table_[10] = BLANK, LINE
    out = table_[buf]
    for lead, low, high in ((0xC3, 0x80, 0xBF), (0xC9, 0x80, 0x8F)):
        at = np.flatnonzero(buf[:-1] == lead)
        follow = buf[at + 1]
        good = (follow >= low) & (follow <= high)
        if lead == 0xC3:
            good &= (follow != 0x97) & (follow != 0xB7)  # the signs × and ÷
        out[at[good]] = LETTER
    inside = np.flatnonzero((buf & 0xC0) == 0x80)
    for _ in range(3):  # a character has three continuation bytes at most
        out[inside] = out[inside - 1]
    return out


def starts_of(buf: np.ndarray, step: int = 1_000_000) -> np.ndarray:
    """Which bytes begin a word by their class and the one before; in steps, as that takes some ten bytes a byte."""
    out = np.ones(len(buf), bool)
    for a in range(1, len(buf), step):
        b, low = min(len(buf), a + step), max(0, a - 4)  # a character has four bytes at most
        kind = classes(buf[low : b + 1])[: b - low]
        now, last = kind[a - low :], kind[a - low - 1 : -1]
        out[a:b] = (now == LINE) | (last == LINE) | ((now == BLANK) & (last != BLANK)) | ((now == LETTER) & (last == OTHER)) | ((now == OTHER) & (last == LETTER))
    return out


def split_words(texts: list[bytes | None]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of all texts in a row (slices of one buffer), and the number of words of each text."""
    ready = [b" " + t.replace(b"\xe2\x96\x81", b" ") if t else b"" for t in texts]
    ends = np.cumsum([0, *map(len, ready)])
    data = b"".join(ready)
    del ready
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    # Of consecutive newlines each is a word; all other marks stand on a change of class, so never inside a character.
    start = starts_of(buf)
    start[ends[:-1][np.diff(ends) > 0]] = True
    at = np.flatnonzero(start)
    offsets = np.append(at, len(buf)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words, np.diff(np.searchsorted(at, ends))


def words_of(text: str | None) -> list[str]:
    words, _ = split_words([(text or "").encode("utf-8", "surrogatepass")])
    return [w.decode("utf-8", "surrogatepass") for w in words.to_pylist()]


def long_word(word: str, p: Pieces, known: dict[str, tuple[int, float]]) -> list[int]:
    """The ids of one word of any length: merges from a heap, or Viterbi with a bounded look back."""
    n = len(word)
    single = lambda c: [known[c][0]] if c in known else [p.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
    if p.kind == "unigram":
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, n + 1):
            options = [(best[s][0] + known[word[s:end]][1], s) for s in range(max(0, end - p.longest), end) if word[s:end] in known]
            if word[end - 1] not in known:
                options.append((best[end - 1][0] + p.unknown_score, end - 1))
            best.append(max(options, key=lambda o: (o[0], o[1])))
        cuts, end = [], n
        while end:
            cuts.append((best[end][1], end))
            end = best[end][1]
        return [i for s, e in reversed(cuts) for i in ([known[word[s:e]][0]] if word[s:e] in known else single(word[s]))]
    after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap: list[tuple[float, int, int]] = []

    def offer(left: int) -> None:
        if left >= 0 and after[left] < n:
            total = size[left] + size[after[left]]
            if total <= p.longest and (k := known.get(word[left : left + total])):
                heapq.heappush(heap, (-k[1], left, total))

    for i in range(n):
        offer(i)
    while heap:
        _, left, total = heapq.heappop(heap)
        right = after[left] if size[left] else n
        if right >= n or size[left] + size[right] != total:
            continue
        size[left], size[right] = total, 0
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
        offer(left)
        offer(before[left])
    out, i = [], 0
    while i < n:
        out += [known[word[i : i + size[i]]][0]] if size[i] > 1 else single(word[i])
        i += size[i]
    return out


#: A BPE edge is one long: rank, start (6 bits), length (5 bits), id (32 bits). A single character has rank 0, so it comes
#: first; one without a piece has length 0 and its UTF-8 bytes in place of the id.
RANK, START, LEN = 43, 37, 32


def lattice(words: DataFrame, p: Pieces) -> DataFrame:
    """(part, word_no, long_ids, n, edges) of (part, word_no, word, long_ids): the edges sorted, n characters.

    Edges are longs as above for BPE, (start, len, score, ids) for unigram models.
    """
    spark, ranks = words.sparkSession, p.ranks()
    rows = [(t, i, s, (ranks[s] << RANK if len(t) > 1 else 0) | len(t) << LEN | i) for t, i, s in p.pieces]
    pieces = spark.createDataFrame(rows, "piece string, id int, score double, packed long")
    if len(p.pieces) <= 1_000_000:
        pieces = F.broadcast(pieces)
    # A word that comes with ids needs no lattice; one edge keeps its row.
    starts = words.select("*", F.explode(F.expr("sequence(0, if(long_ids IS NULL, length(word) - 1, 0))")).alias("start"))
    parts = starts.select("*", F.explode(F.expr(f"sequence(1, if(long_ids IS NULL, least({p.longest}, length(word) - start), 1))")).alias("len"))
    edges = parts.withColumn("piece", F.expr("substring(word, start + 1, len)")).join(pieces, "piece", "left").where(F.col("id").isNotNull() | (F.col("len") == 1))
    if p.kind == "bpe":
        edge = F.expr(f"coalesce(packed, cast(conv(hex(piece), 16, 10) as bigint)) | shiftleft(cast(start as bigint), {START})")
    else:
        ids = ", ".join(map(str, p.byte_ids))
        spelled = F.expr(f"transform(sequence(1, octet_length(piece)), i -> element_at(array({ids}), 1 + cast(conv(substring(hex(piece), 2 * i - 1, 2), 16, 10) as int)))")
        edge = F.struct("start", "len", F.coalesce("score", F.lit(p.unknown_score)).alias("score"), F.when(F.col("id").isNotNull(), F.array("id")).otherwise(spelled).alias("ids"))
    return edges.groupBy("word_no", "part").agg(F.first("long_ids").alias("long_ids"), (F.max("start") + 1).alias("n"), F.sort_array(F.collect_list(edge)).alias("edges"))


def fold_viterbi() -> Column:
    """Ids of a word under a unigram model: for each end the best of (score so far, ids), folded from left to right."""
    step = (
        "(best, i) -> concat(best, array(aggregate(filter(edges, e -> e.start + e.len = i), cast(null as struct<score:double,ids:array<int>>), (b, e) -> "
        "if(b IS NULL OR element_at(best, e.start + 1).score + e.score >= b.score, named_struct('score', element_at(best, e.start + 1).score + e.score, 'ids', concat(element_at(best, e.start + 1).ids, e.ids)), b))))"
    )
    return F.expr(f"element_at(aggregate(sequence(1, n), array(cast(named_struct('score', 0D, 'ids', array()) as struct<score:double,ids:array<int>>)), {step}), -1).ids")


def fold_merges(p: Pieces) -> Column:
    """Ids of a word under a BPE model: bit i of a long says that a token begins or ends before character i."""
    start = lambda e: f"cast(shiftright({e}, {START}) & 63 as int)"
    end = lambda e: f"cast((shiftright({e}, {START}) & 63) + greatest(1, shiftright({e}, {LEN}) & 31) as int)"
    ends = lambda e: f"(shiftleft(1L, {start(e)}) | shiftleft(1L, {end(e)}))"
    inner = lambda e: f"(shiftleft(1L, {end(e)}) - shiftleft(1L, {start(e)} + 1))"
    whole = lambda b, e: f"({b} & {ends(e)}) = {ends(e)}"
    # Of the waiting edges, best first, each one that has become possible merges; after it all are tried again.
    first = f"coalesce(get(transform(filter(s.waiting, x -> {whole('b', 'x')} AND bit_count(b & {inner('x')}) = 1), x -> {inner('x')}), 0), 0L)"
    merged = f"s.borders & ~{inner('e')}"
    settled = f"if(size(s.waiting) = 0, {merged}, aggregate(s.waiting, {merged}, (b, _) -> b & ~{first}))"
    step = (
        f"(s, e) -> if({whole('s.borders', 'e')}, if(bit_count(s.borders & {inner('e')}) = 1, named_struct('borders', {settled}, 'waiting', s.waiting), "
        f"if(bit_count(s.borders & {inner('e')}) > 1, named_struct('borders', s.borders, 'waiting', concat(s.waiting, array(e))), s)), s)"
    )
    borders = f"aggregate(filter(edges, e -> e >= {1 << RANK}), named_struct('borders', shiftleft(1L, n + 1) - 1L, 'waiting', cast(array() as array<bigint>)), {step}).borders"
    tokens = f"sort_array(transform(filter(edges, e -> (borders & ({ends('e')} | {inner('e')})) = {ends('e')}), e -> e & {(1 << RANK) - 1}))"
    ids = ", ".join(map(str, p.byte_ids))
    low = (1 << 32) - 1
    # A character of k bytes has its first one highest.
    spelled = f"transform(filter(array(3, 2, 1, 0), k -> k = 0 OR (t & {low}) >= shiftleft(1L, 8 * k)), k -> element_at(array({ids}), 1 + cast(shiftright(t & {low}, 8 * k) & 255 as int)))"
    plain = f"transform(tokens, t -> cast(t & {low} as int))"
    bare = f"(t & {31 << LEN}) = 0"
    out = f"if(exists(tokens, t -> {bare}), flatten(transform(tokens, t -> if({bare}, {spelled}, array(cast(t & {low} as int))))), {plain})"
    # As arguments of a lambda, the borders and the tokens are computed once for the word.
    return F.expr(f"element_at(transform(transform(array({borders}), borders -> {tokens}), tokens -> {out}), 1)")


def encode_words(words: DataFrame, p: Pieces) -> DataFrame:
    """(part, word_no, ids) of (part, word_no, word, long_ids); nothing is shuffled if they are partitioned by part."""
    fold = fold_merges(p) if p.kind == "bpe" else fold_viterbi()
    return lattice(words, p).select("part", "word_no", F.when(F.col("long_ids").isNotNull(), F.col("long_ids")).otherwise(fold).alias("ids"))


def sizes_of(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bytes) of the words."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return np.diff(offsets), np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def hashes(words: pa.BinaryArray) -> np.ndarray:
    """64 bits for each word, none of them empty."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size, data = sizes_of(words)
    first = np.cumsum(size) - size
    power = np.full(int(size.max()), MULTIPLIER)
    power = np.multiply.accumulate(power)
    h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(first, size)], first)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def canonical(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """An order of distinct words that doesn't depend on how they came, by hash, and the hashes in that order."""
    h = hashes(words)
    order = np.argsort(h, kind="stable")
    if (h[order][1:] == h[order][:-1]).any():
        held = words.to_pylist()
        order = np.array(sorted(range(len(held)), key=lambda i: (h[i], held[i])))
    return order, h[order]


def packed_words(words: pa.BinaryArray) -> bytes:
    size, data = sizes_of(words)
    return zstandard.compress(np.int64(len(size)).tobytes() + size.astype(np.uint32).tobytes() + data.tobytes(), 3)


def unpacked_words(packs: list[bytes]) -> tuple[pa.BinaryArray, list[int]]:
    """The words of all packs in a row and the number of words of each."""
    sizes, data, counts = [np.zeros(1, np.int64)], [], []
    for pack in packs:
        raw = zstandard.decompress(pack)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes.append(np.frombuffer(raw, np.uint32, n, 8).astype(np.int64))
        data.append(raw[8 + 4 * n :])
        counts.append(n)
    offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))]), counts


def distinct(words: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """The distinct words in canonical order, their hashes, and for each word its place among them."""
    coded = words.dictionary_encode()
    order, h = canonical(coded.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), h, rank[coded.indices.to_numpy()]


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the hash, so words in canonical order are also sorted by part."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def encode(docs: DataFrame, p: Pieces, block_bytes: int = 10_000_000, part_words: int = 8_000) -> DataFrame:
    """One row per input row: doc_id, ids (array of int), text_sha256. Words and texts travel compressed."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    # Only for parallelism: distinct words grow with a power of the text, some three million in 860 MB here.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(8_192, int(3e6 * (total / 8.6e8) ** 0.7 / part_words)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of each block of a batch as one compressed Arrow stream."""
        codec = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            h = np.asarray(batch.column("h")).view(np.uint64)
            order = np.argsort(h, kind="stable")
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]])[: len(h)]
            again = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            # Rows that are wholly equal go to one block after the other.
            block = np.empty(len(h), np.int64)
            block[order] = ((h[order] % np.uint64(blocks)).astype(np.int64) + again) % blocks
            order = np.argsort(block, kind="stable")
            held, first = np.unique(block[order], return_index=True)
            rows, packs = pa.Table.from_batches([batch]).select(["doc_id", "text"]).take(pa.array(order)), []
            for a, b in zip(first, [*first[1:], len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=codec) as w:
                    w.write_table(rows.slice(a, b - a))
                packs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(packs, pa.binary())], ["block", "pack"])

    def unpack(packs: pa.Table) -> tuple[list[int | None], list[bytes | None]]:
        held = [pa.ipc.open_stream(x).read_all() for x in packs.column("pack").to_pylist()]
        return [d for x in held for d in x.column("doc_id").to_pylist()], [t for x in held for t in x.column("text").cast(pa.binary()).to_pylist()]

    def ask(key: tuple, packs: pa.Table) -> pa.Table:
        """A block's requests: for each part the words that the block holds."""
        words, h, _ = distinct(split_words(unpack(packs)[1])[0])
        held, first = np.unique(part_of(h, parts), return_index=True)
        asked = [packed_words(words.slice(a, b - a)) for a, b in zip(first, [*first[1:], len(h)])]
        pa.default_memory_pool().release_unused()
        return pa.table({"block": pa.array([key[0].as_py()] * len(held), pa.int32()), "part": pa.array(held, pa.int32()), "words": pa.array(asked, pa.binary())})

    def merge(key: tuple, asked: pa.Table) -> pa.Table:
        """The distinct words of a part, numbered in canonical order."""
        words, _, _ = distinct(unpacked_words(asked.column("words").to_pylist())[0])
        size, data = sizes_of(words)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        ends = np.cumsum(size)
        long = np.flatnonzero(lead[ends] - lead[ends - size] > MOST)
        ids: list[list[int] | None] = [None] * len(words)
        if len(long):
            known = {t: (i, s) for t, i, s in p.pieces}
            for i in long.tolist():
                ids[i] = long_word(words[i].as_py().decode("utf-8", "surrogatepass"), p, known)
        text = pa.Array.from_buffers(pa.string(), len(words), words.buffers(), offset=words.offset)
        return pa.table({"part": pa.array([key[0].as_py()] * len(words), pa.int32()), "word_no": pa.array(np.arange(len(words), dtype=np.int32)), "word": text, "long_ids": pa.array(ids, pa.list_(pa.int32()))})

    def answer(asked: pa.Table, codes: pa.Table) -> pa.Table:
        """To each block its words' ids in the order asked for: lengths, then ids."""
        words, counts = unpacked_words(asked.column("words").to_pylist())
        _, _, place = distinct(words)
        codes = codes.sort_by("word_no").column("ids").combine_chunks()
        out, at = [], 0
        for n in counts:
            found = codes.take(pa.array(place[at : at + n]))
            sizes, ids = np.diff(found.offsets.to_numpy()), found.flatten().to_numpy()
            out.append(zstandard.compress(sizes.astype(np.uint32).tobytes() + ids.astype(np.uint32).tobytes(), 3))
            at += n
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "n": pa.array(counts, pa.int32()), "ids": pa.array(out, pa.binary())})

    def assemble(packs: pa.Table, answers: pa.Table) -> pa.Table:
        doc_ids, texts = unpack(packs)
        sha = [hashlib.sha256(t or b"").hexdigest() for t in texts]
        words, counts = split_words(texts)
        del texts
        place = distinct(words)[2]
        sizes, values = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        answers = answers.sort_by("part")
        for n, raw in zip(answers.column("n").to_pylist(), answers.column("ids").to_pylist(), strict=True):
            got = np.frombuffer(zstandard.decompress(raw), np.uint32)
            sizes.append(got[:n])
            values.append(got[n:])
        codes = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)), pa.array(np.concatenate(values).view(np.int32)))
        found = codes.take(pa.array(place))
        offsets = found.offsets.to_numpy()[np.cumsum([0, *counts])]
        ids = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), found.flatten())
        del words, place, sizes, values, codes, found
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": ids, "text_sha256": pa.array(sha, pa.string())})

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("doc_id", "text"))
    packs = dealt.mapInArrow(pack, "block int, pack binary")
    # A fixed number of partitions for the parts: the words are few bytes but much work.
    asked = packs.groupBy("block").applyInArrow(ask, "block int, part int, words binary").repartition(parts, "part")
    words = asked.groupBy("part").applyInArrow(merge, "part int, word_no int, word string, long_ids array<int>").repartition(parts, "part")
    codes = encode_words(words, p)
    answers = asked.groupBy("part").cogroup(codes.groupBy("part")).applyInArrow(answer, "block int, part int, n int, ids binary")
    return packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, "doc_id long, ids array<int>, text_sha256 string")


def decode(tokens: DataFrame, p: Pieces) -> DataFrame:
    """The rows of `tokens` with the text of `ids` instead of them, and their number as n_tokens.

    Pieces are spelled in hexadecimal, so that byte pieces join to characters; bytes that are no UTF-8 become U+FFFD.
    """
    spelled = f"split('{','.join(n.hex().upper() for n in p.names)}', ',')"  # a constant
    line = F.expr(f"make_valid_utf8(cast(unhex(array_join(transform(coalesce(ids, cast(array() as array<int>)), i -> element_at({spelled}, i + 1)), '')) as string))")
    keep = [c for c in tokens.columns if c != "ids"]
    made = tokens.select(*keep, F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), line.alias("line"))
    return made.select(*keep, F.when(F.startswith(F.col("line"), F.lit(" ")), F.expr("substring(line, 2)")).otherwise(F.col("line")).alias("text"), "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digest of the text and of what its ids decode to, and whether they are equal."""
    p = load()
    tokens = encode(table(spark, sf_dir, "documents"), p)
    back = decode(tokens.withColumn("ids_hash", F.xxhash64("ids")), p)
    return back.select("doc_id", "n_tokens", "ids_hash", "text_sha256", F.sha2("text", 256).alias("decoded_sha256"), (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))
