"""The training-data operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantpanel.llm import decontaminate, exact_dedup, language, license_scan, line_dedup, sentencepiece, sharding, simhash, suffix_dedup, toxicity
from quantpanel.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = "the of and to thon resh inged tionha erwh latte onble shand mirro quand".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + WORDS[j] for i, j in rng.integers(0, len(WORDS), (n, 2)))


LONG_LINE = "a line that is long enough to count as one, surely"
TEXTS = [
    (1, prose(1, 80)), (2, prose(1, 80)), (3, prose(2, 60) + "\n" + LONG_LINE), (4, None), (5, ""), (6, "   "), (7, prose(3, 30000)), (8, LONG_LINE + "\n" + LONG_LINE.upper() + "  "),
    (9, "\t" + LONG_LINE), (10, LONG_LINE), (11, prose(1, 80).replace(" ", "\n ", 1)), (12, "Released under the MIT License.\nLicensed under the Apache Licence, Version 2.0"), (12, "é" * 70), (None, "x"),
    (13, LONG_LINE + "\nend"), (14, "日本語 ▁ 😀\x00" * 9), (15, prose(1, 40) + " changed " + prose(9, 3)),
]
TEXTS += [(16, "again and again"), (16, "again and again")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 1, "x", 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h long, norm string, size int").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"], str(r)))


def sha(b):
    return hashlib.sha256(b).hexdigest()


# --- exact dedup ---------------------------------------------------------------------------------------------------------
def test_exact_dedup(docs, empty):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in TEXTS]
    expected = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        expected.append((i, keep, len(ids), i == keep, sha(t.encode())))
    for bits, size, hot in ((63, 2, None), (63, None, 2), (1, 2, None), (2, 1, 3)):  # few hash bits: chains of different texts
        got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows_of(exact_dedup.exact_dedup(docs, bucket_rows=size, hot_rows=hot, hash_bits=bits))]
        assert sorted(map(str, got)) == sorted(map(str, expected))
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns and {2, 5}.isdisjoint({r.doc_id for r in kept.collect()})
    assert exact_dedup.keep_first_copies(empty).count() == 0


def test_buckets_double_where_they_are_overfull(spark):
    rng = np.random.default_rng(0)
    keys = np.concatenate([rng.integers(0, 2**63, 3000), rng.integers(0, 2**50, 500)])  # half a thousand share their first bits
    buckets = exact_dedup.directory(spark.createDataFrame([(int(k), 1) for k in np.unique(keys)], "key long, n long"), 100, 10)
    assert sum(b[2] for b in buckets) == len(np.unique(keys)) and all(b[2] <= 100 for b in buckets) and len({b[1] for b in buckets}) > 3
    ends = [first + (1 << (63 - depth)) for first, depth, _, _ in buckets]
    assert all(a <= b[0] for a, b in zip(ends, buckets[1:]))
    owners = [o for _, _, o in exact_dedup.dealt(buckets, 8)]
    assert owners == sorted(owners) and set(owners) == set(range(8))


def test_a_hot_text_is_aggregated_where_it_stands(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 1, F.lit("hot  text")).otherwise(F.concat(F.lit("text "), (F.col("id") % 900).cast("string"))).alias("text"))
    truth = df.groupBy(exact_dedup.normalised().alias("n")).agg(F.min("doc_id").alias("k"), F.count("*").alias("c"))
    expected = sorted(map(tuple, df.withColumn("n", exact_dedup.normalised()).join(truth, "n").select("doc_id", "k", "c").collect()))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()) == expected


#: Ids that repeat with different texts, null ids, and copies among them.
ODD_ROWS = [(1, "same text"), (12, "same text"), (12, "wholly different"), (None, "same text"), (3, "½ ²"), (None, None), (7, None)]


def odd_rows(spark, more=()):
    return spark.createDataFrame([(i, t, 0, "x", 1) for i, t in [*ODD_ROWS, *more]], "doc_id long, text string, row_id int, row string, key int")


def kept_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_exact_dedup_drops_rows_not_ids(spark):
    got = exact_dedup.keep_first_copies(odd_rows(spark))
    assert got.columns == ["doc_id", "text", "row_id", "row", "key"]
    assert kept_rows(got) == sorted([(1, "same text"), (12, "wholly different"), (3, "½ ²"), (7, None)], key=str)


# --- sharding ------------------------------------------------------------------------------------------------------------
def test_sharding(spark, docs, empty):
    got = rows_of(sharding.shard(docs, 5))
    sizes = sorted(len((t or "").encode()) + 8 for _, t in TEXTS)
    assert sorted(r["size"] for r in got) == sizes and sorted(r["text_crc32"] for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in TEXTS)
    for s, rows in itertools.groupby(sorted(got, key=lambda r: r["shard"]), key=lambda r: r["shard"]):
        assert 0 <= s < 5 and sorted(r["slot"] for r in rows) == list(range(len([r for r in got if r["shard"] == s])))
    assert sharding.shard(empty, 5).count() == 0
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 50)).otherwise(F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), F.lit(20)))).alias("text"))
    by = sharding.shard(many, 24).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).toPandas()
    assert len(by) == 24 and by["b"].max() < 1.03 * by["b"].mean() and (by["m"] + 1 == by["n"]).all()


def test_sharding_by_many_ranges(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 9)).otherwise(F.repeat(F.col("id").cast("string"), F.lit(9))).alias("text"))
    few, fine = (rows_of(sharding.shard(many, 7, range_bytes=b)) for b in (10**9, 500))
    assert len(few) == len(fine) == 6000 and [(r["size"], r["text_crc32"]) for r in few] == [(r["size"], r["text_crc32"]) for r in fine]
    for got in (few, fine):
        sizes = {s: sum(r["size"] for r in got if r["shard"] == s) for s in range(7)}
        assert max(sizes.values()) < 1.03 * min(sizes.values())
        for s in range(7):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        for r in got:
            assert r["text_crc32"] == zlib.crc32(("hot " * 9 if r["doc_id"] % 3 == 0 else str(r["doc_id"]) * 9).encode()) and r["law"] == "bytes" and r["grown_shard"] is None


# --- line dedup ----------------------------------------------------------------------------------------------------------
def test_line_dedup(docs, empty):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for n, (i, t) in enumerate(TEXTS):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), {})[n] = -1 if i is None else i
    expected = []
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and max(holders[key(x)].values()) != i)]
        expected.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows_of(line_dedup.line_dedup(docs))]
    assert sorted(map(str, got)) == sorted(map(str, expected)) and sum(x[2] for x in expected) > 3
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_equals_its_sql_where_ids_repeat(spark):
    import duckdb
    import pyarrow as pa

    long = [f"{k} {LONG_LINE}" for k in range(4)]
    rows = [(1, long[0]), (1, long[0]), (2, long[0] + "\n" + long[1]), (2, long[0]), (3, long[0] + "\n"), (None, long[1]), (None, long[1] + "\n" + long[1]), (4, long[1]), (5, long[1]), (5, None), (6, ""), (7, long[2])]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    expected = sorted(map(str, con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.SQL})").fetchall()))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256)) for r in got.collect()) == expected


def test_a_line_of_a_third_of_all_documents_is_dealt_to_many_tasks(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(LONG_LINE)).otherwise(F.concat(F.lit("own line of some forty characters in all "), F.col("id").cast("string"))).alias("text"))
    got = line_dedup.line_dedup(df, task_bytes=2_000)
    assert got.where("n_dropped = 1").count() == 1999 and got.count() == 6000


def test_perfect_hash_is_minimal():
    h = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    p = line_dedup.PerfectHash.build(h)
    assert sorted(p.index(h).tolist()) == list(range(len(h)))
    assert line_dedup.PerfectHash.build(h[:0]).index(h).tolist() == [-1] * len(h)


def test_a_long_text_of_one_notice_takes_linear_time():
    """Five megabytes of matches; five seconds on an idle machine."""
    notices = [license_scan.Notice(*n) for n in license_scan.NOTICES]
    began = time.time()
    got = license_scan.scan_text("released under the mit license " * 160_000, notices)
    assert time.time() - began < 30 and got["n_base"] == len(got["spans"]) == 160_000
    assert (got["first_word"], got["last_word"]) == (3, 159_999 * 5 + 3) and got["spans"][-1]["first_word"] == 159_999 * 5


@pytest.mark.parametrize("n, block", [(1, 8), (8, 8), (9, 8), (64, 8), (1000, 16), (257, 256)])
def test_long_chains_are_exact(n, block):
    rng = np.random.default_rng(n)
    field = language.Field(list("abc"), np.zeros((1, 3)), rng.normal(0, 2, (3, 3)), rng.normal(0, 1, 3))
    emit = rng.normal(0, 4, (n, 3))
    whole = language.forward_backward_words(emit[None], np.array([n]), field)[0]
    assert np.abs(language.forward_backward_long(emit, field, block) - whole).max() < 1e-9


# --- suffix arrays -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("text", [b"", b"a", b"banana", b"mississippi", b"aaaa", b"abab\x00abab", bytes(range(255, 0, -1)) * 2])
def test_suffix_array(text):
    assert suffix_dedup.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(rows):
    seen, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            w = b[j : j + 50]
            seen[w] = min(seen.get(w, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if seen[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone)), sha(kept)))
    return out


def test_suffix_dedup(spark, docs, empty, monkeypatch):
    base = [prose(k, 60) for k in range(4)]
    rows = [(k, base[k % 4][: 40 * k] + f" own {k} " + base[(k + 1) % 4][30 * k :] + " " + prose(50 + k, 5)) for k in range(12)] + [(20, base[0]), (21, base[0]), (22, "ab" * 90), (23, "ab" * 80), (24, None), (25, "é" * 40), (26, "é" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shown = lambda d: [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(d)]
    expected = brute_repeats(rows)
    assert shown(suffix_dedup.suffix_dedup(df)) == expected and sum(x[2] for x in expected) > 500
    assert suffix_dedup.suffix_dedup(docs).count() == len(TEXTS) and suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_repeated_and_large_ids(spark):
    """Rows of one id, null included, take nothing from each other; all lose what stands under a smaller id."""
    passage, other = prose(4, 30), prose(8, 30)
    rows = [(2**50, "a " + passage), (2**50, "b " + passage + " c"), (2**62, passage + " d"), (None, "e " + passage), (None, passage), (-5, passage)]
    rows += [(7, other), (7, other), (7, "x " + other + passage[:70]), (9, other), (9, "y " + other)]
    ids = sorted({i for i, _ in rows if i is not None})
    expected = brute_repeats([(ids.index(i) if i is not None else -1, t) for i, t in rows])
    got = [(ids.index(r.doc_id) if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(expected)
    assert {x[2] for x in got if x[0] == -1} == {0} and sum(x[2] > 0 for x in got) == 7


def test_large_groups_are_split_by_window(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 400)
    strings = [prose(1, 9).encode()[:60], prose(1, 9).encode()[:58], prose(2, 9).encode()[:70]] * 3
    got = suffix_dedup.resolve(np.zeros(9, int), strings, np.arange(9))
    assert [x.tolist() for x in got] == [x.tolist() for x in suffix_dedup.smallest_docs(strings, np.arange(9))]


# --- SimHash -------------------------------------------------------------------------------------------------------------
def test_simhash_components(docs, empty):
    got = rows_of(simhash.near_duplicates(docs))
    fp = {n: int(r["fingerprint"], 16) for n, r in enumerate(got)}
    link = {n: {m for m in fp if bin(fp[n] ^ fp[m]).count("1") <= 3} for n in fp}
    for n, r in enumerate(got):
        group, edge = {n}, {n}
        while edge := {m for k in edge for m in link[k]} - group:
            group |= edge
        assert r["component_id"] == min((got[m]["doc_id"] for m in group if got[m]["doc_id"] is not None), default=None)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (4, 5, 6)} == {"0" * 16}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("distance", [3, 6])
def test_every_link_is_found(spark, distance):
    rng = np.random.default_rng(distance)
    centre = rng.integers(0, 2**63, 60).astype(np.uint64)
    noise = [centre ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in centre], np.uint64) for _ in range(6)]
    fp = np.unique(np.concatenate([centre, *noise]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    p = simhash.plan(fp, len(fp), distance)
    assert sum(t + 1 for t in p.thresholds) == distance + 1 and sorted(b for part in p.parts for b in part) == list(range(64))
    far = np.bitwise_count(fp[:, None] ^ fp[None, :])
    truth = dict(zip(*(x.tolist() for x in simhash.local_links(*(fp[k] for k in np.nonzero((far <= distance) & (far > 0)))))))
    roots = {r.node: r.root for r in components(simhash.links(df, p, distance)).collect()}
    groups = lambda of: sorted(sorted(k for k in of if of[k] == v) for v in set(of.values()))
    signed = lambda x: int(np.uint64(x).view(np.int64))
    full = {signed(x): signed(truth.get(int(x), int(x))) for x in fp}
    linked = {x: r for x, r in full.items() if list(full.values()).count(r) > 1}
    assert groups(roots) == groups(linked)


def test_verified_duplicates(spark):
    base = [prose(k, 200).split() for k in range(5)]
    rows = []
    for k, words in enumerate(base):
        edited = [*words[:100], "edited", *words[101:]]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(edited)), (10 * k + 2, " ".join(words[:120] + prose(90 + k, 80).split()))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one_of_each(df).collect()} == {i for i, _ in rows if i % 10 != 1}


def test_a_repeated_footer_does_not_hide_a_copy(spark):
    rows = []
    for k in range(8):
        footer = " " + prose(200 + k, 12)
        rows += [(10 * k, prose(k, 400) + footer), (10 * k + 1, prose(k, 400) + footer * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one_of_each(df).collect()} == {10 * k for k in range(8)}


def test_pairs_among_many_documents_of_one_template(spark):
    template, rows = prose(500, 250).split(), []
    for k in range(700):
        rng = np.random.default_rng(k)
        at = lambda words, n, seed: [w if m not in lost else f"own{seed}x{m}" for lost in [set(rng.choice(len(words), n, replace=False).tolist())] for m, w in enumerate(words)]
        own = at(template, 5, 2 * k)
        rows.append((2 * k, " ".join(own)))
        if k < 60:
            rows.append((2 * k + 1, " ".join(at(own, 5, 2 * k + 1))))
    grams = {i: {tuple(t.split()[m : m + 5]) for m in range(len(t.split()) - 4)} for i, t in rows}
    ids = sorted(grams)
    fp = {i: simhash.fingerprint(t, 5, True) for i, t in rows}
    near = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 14 and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    assert len(near) > 30
    first = {i: i for i in ids}
    for _ in ids:
        before = dict(first)
        for a, b in near:
            first[a] = first[b] = min(first[a], first[b])
        if first == before:
            break
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one_of_each(df).collect()} == {i for i in ids if first[i] == i}


def test_every_document_of_an_equal_fingerprint_is_compared(spark):
    words = prose(700, 300).split()
    at = np.random.default_rng(70).choice(60, 7, replace=False) * 5
    far = [f"y70x{m}" if m in at else w for m, w in enumerate(words)]
    middle = [far[m] if m == at[0] else w for m, w in enumerate(words)]
    texts = [" ".join(w) for w in (words, middle, far)]
    sets = [{tuple(w[m : m + 5]) for m in range(len(w) - 4)} for w in (words, middle, far)]
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    a, b, c = [simhash.fingerprint(t, 5, True) for t in texts]
    assert a == b and (a ^ c).bit_count() <= 14 and jaccard(0, 2) < 0.8 <= jaccard(1, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one_of_each(df).collect()} == {0}


def test_near_duplicates_drop_rows_not_ids(spark):
    words = prose(3, 200).split()
    near = " ".join([*words[:90], "edited", *words[91:]])
    df = odd_rows(spark, [(12, " ".join(words)), (12, near), (None, near + " end"), (40, prose(8, 100)), (40, prose(8, 100))])
    got = kept_rows(simhash.keep_one_of_each(df))
    assert len({t for i, t in got if t in (" ".join(words), near, near + " end")}) == 1
    texts = [t for _, t in got]
    assert texts.count("same text") == 1 and (1, "same text") in got and (12, "wholly different") in got and texts.count(prose(8, 100)) == 2


def test_large_buckets_are_dealt_over_tiles(spark):
    tile, rng = 40, np.random.default_rng(40)
    centre = int(rng.integers(2**62))
    fp = np.unique(np.array([centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(150)], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    p = simhash.plan(fp, len(fp), 3)
    groups = lambda roots: sorted(sorted(k for k in roots if roots[k] == v) for v in set(roots.values()))
    one, many = ({r.node: r.root for r in components(simhash.links(df, p, 3, tile=t)).collect()} for t in (None, tile))
    assert one and groups(one) == groups(many)
    words = prose(900, 150).split()
    rows = [(k, " ".join([*words[: 3 * k], f"own{k}", *words[3 * k + 1 :]])) for k in range(40)] + [(100 + k, prose(300 + k, 150)) for k in range(40)]
    near = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one_of_each(near, tile=tile).collect()} == {0, *range(100, 140)}


def plain_fingerprint(text):
    import xxhash

    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return "".join("1" if sum(x >> b & 1 for x in h) * 2 > len(h) else "0" for b in range(63, -1, -1))


def test_fingerprints_are_those_of_the_contract(docs):
    texts = {(i, plain_fingerprint(t)) for i, t in TEXTS if len(t or "") < 5000}
    got = {(r["doc_id"], f"{int(r['fingerprint'], 16):064b}") for r in simhash.near_duplicates(docs).collect()}
    assert texts <= got


def test_components_of_a_chain(spark):
    n = 300
    order = np.random.default_rng(0).permutation(n).tolist()
    df = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


# --- decontamination -----------------------------------------------------------------------------------------------------
def test_masks_keep_a_seed_whole():
    for window in range(5, decontaminate.WINDOW + 1):
        for gone in itertools.combinations(range(window), decontaminate.allowed(window)):
            assert any(all(at + o < window and at + o not in gone for o in mask) for mask in decontaminate.MASKS for at in range(window)), (window, gone)


def test_decontamination(spark, docs, empty):
    item = prose(70, 30)
    words = item.split()
    swapped = [*words[:5], "other", *words[6:9], "thing", *words[10:13]]
    rows = [(1, prose(71, 50) + " " + item.upper() + ". " + prose(72, 9)), (2, prose(73, 50)), (3, "x " + " ".join(swapped) + " y"), (4, " ".join(words[:12])), (5, None), (6, ""), (7, "z, " + "; ".join(words[10:23])), (8, "five words of an item")]
    bench = spark.createDataFrame([(9, item), (10, "five words of an item"), (11, "too short"), (12, None)], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.decontamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: [9], 2: [], 3: [9], 4: [], 5: [], 6: [], 7: [9], 8: [10]}
    assert decontaminate.decontamination(docs, bench).count() == len(TEXTS) and decontaminate.decontamination(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(TEXTS)


def test_decontamination_drops_rows_not_ids(spark):
    item = prose(70, 30)
    bench = spark.createDataFrame([(9, item), (None, prose(75, 30))], "item_id long, text string")
    df = odd_rows(spark, [(12, item), (None, "a " + item), (1, prose(75, 30))])
    got = decontaminate.drop_contaminated(df, bench)
    assert got.columns == df.columns and kept_rows(got) == sorted([*ODD_ROWS, (1, prose(75, 30))], key=str)
    marks = sorted(((r.doc_id, r["items"]) for r in decontaminate.decontamination(df, bench).where("contaminated").collect()), key=str)
    assert marks == sorted([(12, [9]), (None, [9])], key=str)


def test_decontamination_equals_all_windows(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(words[i] for i in rng.integers(0, 60, n))) for k, n in enumerate([3, 5, 7, 8, 9, 10, 12, 13, 14, 30, 60])]
    rows = []
    for k in range(120):
        text = [words[i] for i in rng.integers(0, 60, 25)]
        item = items[int(rng.integers(len(items)))][1].split()
        cut = item[: int(rng.integers(3, len(item) + 1))] if rng.random() < 0.4 else item
        for at in rng.integers(0, len(cut), int(rng.integers(0, 4))):
            cut = [*cut[:at], "other", *cut[at + 1 :]]
        rows.append((k, " ".join(text[:9] + cut + text[9:])))
    expected = {}
    for k, t in rows:
        a = t.split()
        for i, u in items:
            b = u.split()
            n = min(13, len(b))
            fits = [sum(x != y for x, y in zip(a[p : p + n], b[q : q + n])) for p in range(len(a) - n + 1) for q in range(len(b) - n + 1)]
            if n >= 5 and fits and min(fits) <= decontaminate.allowed(n):
                expected.setdefault(k, []).append(i)
    got = {r.doc_id: r["items"] for r in decontaminate.decontamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()}
    assert got == expected and len(got) > 40


def python_in_stages(df):
    """How many Python operators each stage of the plan has, as a shuffle or broadcast ends a stage."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def count(node):
        """Python operators of the node's own stage."""
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return count(node.initialPlan())
        below = [node.children().apply(i) for i in range(node.children().size())]
        own = sum(map(count, below)) + name.endswith("InArrow")
        if "Exchange" in name:
            found.append(own)
            return 0
        return own

    last = count(plan)
    return sorted([*found, last])


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_decontamination_has_one_python_worker_a_task(spark, broadcast_rows):
    item = prose(70, 30)
    docs = spark.createDataFrame([(1, "x " + item), (2, prose(73, 50))], "doc_id long, text string")
    found = decontaminate.overlaps(docs, spark.createDataFrame([(9, item)], "item_id long, text string"), broadcast_rows)
    # Two in one stage hold twice the workers, and executors keep those for all that follows.
    in_stages = python_in_stages(found)
    assert sum(in_stages) == 2 and max(in_stages) == 1
    assert [(r.row_id, r.item_id, r.words) for r in found.collect()] == [(1, 9, 13)]


# --- licenses ------------------------------------------------------------------------------------------------------------
def test_license_scan(docs, empty):
    got = {r["doc_id"]: r for r in rows_of(license_scan.license_scan(docs))}
    assert got[12]["n_words"] in (1, 13) and got[4]["n_words"] == 0 and got[5]["score"] == 0 and got[4]["first_word"] is None
    row = next(r for r in rows_of(license_scan.license_scan(docs)) if r["labels"])
    assert (row["n_base"], row["first_word"], row["last_word"], row["base_labels"], row["labels"]) == (1, 3, 3, "mit", "apache,mit")
    assert license_scan.license_scan(empty).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_notice_is_found_within_its_edits():
    n = license_scan.Notice("permission is hereby granted free of charge", "mit", 3)
    rng = np.random.default_rng(0)
    for _ in range(60):
        text = list(n.notice)
        for _ in range(3):
            text[int(rng.integers(1, len(text) - 1))] = chr(97 + int(rng.integers(26)))
        line = b" xx " + "".join(text).encode() + b" yy "
        found = list(n.matches(line))
        assert found and found[0][2] == edits("".join(text), n.notice)
    assert not list(n.matches(b" nothing of the kind is granted "))


def test_base_phrases_stand_where_their_words_do():
    rng = np.random.default_rng(3)
    words = ["MIT", "license", "apache", "Apache", "general", "public", "License", "x", "é1"]
    for _ in range(300):
        text = "".join(words[i] + (" ", ", ", "\n", "-")[j] for i, j in zip(rng.integers(0, len(words), 30), rng.integers(0, 4, 30)))
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        found = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower)
        places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
        got = license_scan.scan_text(text, [])
        assert (got["n_words"], got["n_base"]) == (len(found), len(places))
        assert (got["first_word"], got["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert got["base_labels"] == got["labels"] == ",".join(sorted({x for _, x in places}))


def test_every_notice_is_found_with_letters_lost_added_and_changed():
    rng = np.random.default_rng(4)
    for notice, label, most in license_scan.NOTICES:
        n = license_scan.Notice(notice, label, most)
        for _ in range(8):
            text = list(notice)
            for _ in range(most):
                at, what = int(rng.integers(1, len(text) - 1)), int(rng.integers(3))
                text[at : at + 1] = [[], [text[at], "q"], ["z"]][what]
            found = list(n.matches(b" xx " + "".join(text).encode() + b" yy "))
            assert found and min(f[2] for f in found) <= edits("".join(text), notice)


def test_repeated_notices_are_all_counted():
    notices = [license_scan.Notice("all rights reserved", "reserved", 1)]
    spans = lambda t: [(s["first_word"], s["last_word"], s["edits"]) for s in license_scan.scan_text(t, notices)["spans"]]
    assert spans("all rights reserve x all rights reserved") == [(0, 2, 1), (4, 6, 0)]
    assert spans("all rights reserved all rights reserved") == [(0, 2, 0), (3, 5, 0)]
    assert spans("a all right reserved all rights reserved b all rights reservd") == [(1, 3, 1), (4, 6, 0), (8, 10, 1)]
    assert spans("all rights reservd " * 300) == [(3 * k, 3 * k + 2, 1) for k in range(300)]


# --- toxicity and language -----------------------------------------------------------------------------------------------
def test_toxicity_learns_a_pair(spark, docs, empty):
    """Only an insult together with a group mention is toxic: no additive weight can say so."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(900):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([WORDS[int(rng.integers(len(WORDS)))] for _ in range(6)] + ["scumlord"] * insult + ["outgroup"] * group)))
        labels.append((i, int(insult and group)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i, _ in rows)
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.97
    assert toxicity.toxicity(docs, lab).count() == len(TEXTS) and toxicity.toxicity(empty, lab).count() == 0
    assert {r.score for r in toxicity.toxicity(df, lab.limit(0)).collect()} == {1 / (1 + np.exp(40.0))}


def test_toxicity_learns_what_neither_term_says_alone(spark):
    """Toxic is one of two terms without the other: each term alone is neutral."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([WORDS[int(rng.integers(len(WORDS)))] for _ in range(6)] + ["scumlord"] * a + ["outgroup"] * b)))
        labels.append((i, int(a != b)))
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95


def test_scores_equal_the_sum_over_all_pairs():
    """w0 + sum of w + sum of <v_i, v_j> over every pair of a text's slots, written out."""
    rng = np.random.default_rng(5)
    words = ["insult", "group", "neutral", "other", "Straße", "日本語"]
    slots = np.unique([s for w in words for s in toxicity.word_slots(w.lower())])[:-1]
    machine = toxicity.Machine(slots, 0.3, rng.normal(0, 1, len(slots)), rng.normal(0, 1, (len(slots), 4)))
    texts = [None, "", "Insult, group!", "group group insult neutral", " ".join(words), "nothing known", "日本語 other"]
    for text, got in zip(texts, toxicity.Scorer(machine)(texts), strict=True):
        at = [i for i, s in enumerate(slots) if s in toxicity.slots_of(text, toxicity.Slots())]
        z = 0.3 + sum(machine.w[i] for i in at) + sum(machine.v[i] @ machine.v[j] for i, j in itertools.combinations(at, 2))
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_drops_rows_not_ids(spark):
    rows = [(100 + i, f"some {w} words here {i}") for i, w in enumerate(["vile", "kind", "mere", "mere"] * 40)]
    lab = spark.createDataFrame([(i, int("vile" in t)) for i, t in rows] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    df = odd_rows(spark, [*rows, (100, "a kind word"), (12, "such vile words"), (None, "vile"), (None, "vile")])
    got = toxicity.drop_toxic(df, lab)
    assert got.columns == df.columns and kept_rows(got) == sorted([*ODD_ROWS, *((i, t) for i, t in rows if "vile" not in t), (100, "a kind word")], key=str)
    assert toxicity.drop_toxic(df.limit(0), lab).count() == 0


def test_language(spark, docs, empty):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    field = language.train(df)
    got = {r.doc_id: r for r in language.identify(df, field).collect()}
    held = [r for r in df.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.9
    odd = rows_of(language.identify(docs, field))
    assert len(odd) == len(TEXTS) and all(r["lang_pred"] == "und" for r in odd if r["doc_id"] in (4, 5, 6))
    assert language.identify(empty, field).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.train(empty)).collect()} == {"und"}
    signs = spark.createDataFrame([(1, "½ ² Ⅷ"), (2, "12 ३ __ ..."), (3, "x²")], "doc_id long, text string")
    assert [(r.lang_pred == "und", r.score == 0) for r in language.identify(signs, field).orderBy("doc_id").collect()] == [(True, True), (True, True), (False, False)]
    # Code-switched text: passages of eight words, a language each.
    rng, by = np.random.default_rng(0), {}
    for r in held:
        by.setdefault(r.lang, []).append(language.words_of(r.text))
    words, truth = [], []
    for _ in range(40):
        for lang in rng.permutation(sorted(by)).tolist():
            source = max(by[lang], key=len)
            at = int(rng.integers(len(source) - 8))
            words += source[at : at + 8]
            truth += [lang] * 8
    labels = language.label_words(field, " ".join(words))
    assert [w for w, _, _ in labels] == words and np.mean([lang == t for (_, lang, _), t in zip(labels, truth)]) > 0.85


def test_words_count_whole():
    same = "x" * 50
    slots = lambda w: language.features([w])[0].tolist()
    assert slots(same + "abc") != slots(same + "abd") and len(slots(same * 3)) > 2 * len(slots(same)) - 20


def test_language_of_odd_rows(spark):
    rows = [(1, "un deux trois", "fr"), (1, "one two three", "en"), (None, "vier fünf", "de"), (2, None, "en"), (3, "sechs", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(df, language.train(df)).collect()
    assert len(got) == len(rows) and all(r.lang_pred == "und" for r in got if r.doc_id == 2)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, moves, start = rng.normal(size=(1, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    total = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        w = np.exp(start[path[0]] + sum(emit[0, t, s] for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        for t, s in enumerate(path):
            total[t, s] += w
    expected = total / total.sum(1, keepdims=True)
    np.testing.assert_allclose(language.forward_backward(emit, np.array([5]), moves, start)[0][0], expected)
    np.testing.assert_allclose(language.forward_backward_words(emit, np.array([5]), language.Field(list("abc"), emit, moves, start))[0], expected)


# --- SentencePiece -------------------------------------------------------------------------------------------------------
def test_sentencepiece_equals_the_library(spark, docs, empty):
    import sentencepiece as library

    model, p = library.SentencePieceProcessor(model_file=sentencepiece.MODEL), sentencepiece.load()
    tokens = sentencepiece.encode(docs, p)
    got = sorted((str(r.doc_id), list(r.ids)) for r in tokens.collect())
    assert got == sorted((str(i), model.encode(t or "")) for i, t in TEXTS)
    back = sorted((str(r.doc_id), r.text) for r in sentencepiece.decode(tokens, p).collect())
    assert back == sorted((str(i), (t or "").replace("▁", " ")) for i, t in TEXTS)
    assert sentencepiece.encode(empty, p).count() == 0


def test_words_are_those_of_the_pattern():
    rng = np.random.default_rng(0)
    signs = [*"ab ZÀ×Öø÷ɏɐȿžñ\n\n  ▁.,1日😀\x00é"]
    for n in range(300):
        texts = ["".join(signs[i] for i in rng.integers(0, len(signs), rng.integers(0, 40))) for _ in range(5)] + [None]
        words, counts = sentencepiece.split_words([None if t is None else t.encode() for t in texts])
        expected = [sentencepiece.WORDS.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        assert counts.tolist() == [len(x) for x in expected] and [w.decode() for w in words.to_pylist()] == [w for x in expected for w in x]


def test_merges_equal_the_library_on_random_words(spark):
    import sentencepiece as library

    model, rng = library.SentencePieceProcessor(model_file=sentencepiece.MODEL), np.random.default_rng(1)
    signs = [*"aaeehtnsrio  ..,--11éß日😀"]
    texts = ["".join(signs[i] for i in rng.integers(0, len(signs), 200)) for _ in range(150)] + ["a" * n for n in (1, 2, 59, 60, 61, 700)] + ["ab" * 90, "=" * 400, " " * 130]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in sentencepiece.encode(df, sentencepiece.load(), block_bytes=4_000).collect()}
    assert got == {i: model.encode(t) for i, t in enumerate(texts)}


def test_equal_rows_are_dealt_over_blocks(spark):
    df = spark.createDataFrame([(1, "the same row")] * 600, "doc_id long, text string").coalesce(1)
    got = sentencepiece.encode(df, sentencepiece.load(), block_bytes=1_000)
    assert got.count() == 600 and len({tuple(r.ids) for r in got.collect()}) == 1


def test_viterbi_fold_finds_the_best_path(spark):
    pieces = [("a", 0, -1.0), ("b", 1, -1.5), ("ab", 2, -2.0), ("ba", 3, -1.9), ("aba", 4, -3.2), (" ", 5, -0.5), (" a", 6, -1.2)]
    p = sentencepiece.Pieces("unigram", pieces, list(range(10, 266)), [b""] * 266, 3)
    known = {t: (i, s) for t, i, s in pieces}
    words = [" " + "".join(w) for n in range(1, 6) for w in itertools.product("abc", repeat=n)]
    rows = spark.createDataFrame([(0, i, w, None) for i, w in enumerate(words)], "part int, word_no int, word string, long_ids array<int>")
    got = {words[r.word_no]: list(r.ids) for r in sentencepiece.encode_words(rows, p).collect()}
    score = lambda ids: sum({i: s for _, i, s in pieces}.get(i, p.unknown_score) for i in ids)
    for w in words:
        assert score(got[w]) == pytest.approx(score(sentencepiece.long_word(w, p, known)))
