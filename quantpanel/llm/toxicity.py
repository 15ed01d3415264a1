"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and the first four letters of the longer ones, hashed into 2**18 slots.
The machine scores sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>), so that a pair of terms (an insult and a group
mention) can weigh more, or less, than both alone. Two kinds of slots take part: those whose presence depends on the
label by a chi-square of at least `min_chi2`, and those of pairs whose log odds depend on each other, which includes pairs
that are neutral one by one. All other terms weigh nothing. See `fit` for the bounds of the model's size.

Training uses a sample of at most `max_rows` labelled rows of the learning fold (smallest hash of the id first, so the
sample is the same for the same labels). It is the only thing that reaches the driver: `max_rows` arrays of slots.

Defined cases: null and empty texts get sigmoid(w0), the score of a text without terms; a null id is in the held-out
fold and never learned from; of several labels of one id the largest counts, for all rows with it; without labelled rows
or without one of the two classes, the score is the share of label 1 (0 without labels); repeated rows are scored each,
and each row is kept or dropped by its own text; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm.common import table

WORD = re.compile(r"[^\W\d_]+")
SLOTS = 1 << 18


def word_slots(word: str) -> tuple[int, ...]:
    found = (zlib.crc32(word.encode()) % SLOTS,)
    return found + (zlib.crc32(b"^" + word[:4].encode()) % SLOTS,) if len(word) > 4 else found


class Slots(dict):
    """Word to its slots; emptied when it holds `most` words."""

    most = 100_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = word_slots(word)
        return found


def slots_of(text: str | None, cache: Slots) -> set[int]:
    return {s for w in set(WORD.findall((text or "").lower())) for s in cache[w]}


@dataclass
class Machine:
    slots: np.ndarray  # sorted slots that take part
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: for each text the positions of its slots within `slots`."""
        out = np.full(len(rows), self.w0)
        for i, r in enumerate(rows):
            if len(r):
                v = self.v[r]
                out[i] += self.w[r].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return out


def pair_dependence(x: np.ndarray, labels: np.ndarray, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, z squared) of columns i < j of x: how far the log odds of the label for j differ between rows with i and without.

    Single weights explain two columns whose odds multiply; this is what is left for the pair. In blocks of `step` by
    `step` columns; x holds bytes.
    """
    y = labels.astype(np.float32)
    n, positive = np.float32(len(y)), np.float32(y.sum())
    has, has_y = x.sum(0, dtype=np.float32), x[labels > 0].sum(0, dtype=np.float32)
    for at in range(0, x.shape[1], step):
        left = x[:, at : at + step].astype(np.float32).T.copy()
        a, a_y = has[at : at + step, None], has_y[at : at + step, None]
        for to in range(at, x.shape[1], step):
            right = x[:, to : to + step].astype(np.float32)
            b, b_y = has[to : to + step], has_y[to : to + step]
            both, both_y = left @ right, left @ (right * y[:, None])
            # With i and j, i alone, j alone, neither: rows of label 1 and 0, half a row added to each.
            ones = [both_y, a_y - both_y, b_y - both_y, positive - a_y - b_y + both_y]
            alls = [both, a - both, b - both, n - a - b + both]
            odds, noise = 0.0, 0.0
            for sign, one, every in zip((1, -1, -1, 1), ones, alls, strict=True):
                odds = odds + sign * np.log((one + 0.5) / (every - one + 0.5))
                noise = noise + 1 / (one + 0.5) + 1 / (every - one + 0.5)
            z = odds**2 / noise
            i, j = np.nonzero((z > 30) & (np.arange(at, at + len(left))[:, None] < np.arange(to, to + right.shape[1])))
            yield i + at, j + to, z[i, j]


def chosen_slots(rows: list[np.ndarray], labels: np.ndarray, max_terms: int, min_chi2: float, max_pairs: int, min_pair: float, min_rows: int) -> np.ndarray:
    """The slots that depend on the label, and the pairs of slots that depend on it beyond what both say alone."""
    n, positive = len(labels), float(labels.sum())
    a, b = np.zeros(SLOTS), np.zeros(SLOTS)
    for r, y in zip(rows, labels, strict=True):
        (a if y else b)[r] += 1
    c, d, m = positive - a, n - positive - b, a + b
    chi2 = n * (a * d - b * c) ** 2 / np.maximum(1, m * (n - m) * positive * (n - positive))
    single = np.argsort(-chi2, kind="stable")[:max_terms]
    single = single[chi2[single] >= min(min_chi2, chi2.max())]
    often = np.flatnonzero((m >= min_rows) & (m <= n - min_rows))
    often = np.sort(often[np.argsort(-m[often], kind="stable")[:4_096]])
    place = np.full(SLOTS, -1)
    place[often] = np.arange(len(often))
    x = np.zeros((n, len(often)), np.uint8)
    for i, r in enumerate(rows):
        at = place[r]
        x[i, at[at >= 0]] = 1
    pairs = [np.zeros(0, int)]
    found = [np.concatenate(f) for f in zip(*pair_dependence(x, labels), strict=True)] if len(often) else [np.zeros(0, int)] * 3
    best = np.argsort(-found[2], kind="stable")[:max_pairs]
    best = best[found[2][best] >= min_pair]
    pairs += [often[found[0][best]], often[found[1][best]]]
    return np.unique(np.concatenate([single, *pairs]))


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = 8, max_terms: int = 256, min_chi2: float = 12.0, max_pairs: int = 64, min_pair: float = 40.0, min_rows: int = 40, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> Machine:
    """Adam on the mean log loss with weight decay; `rows` are arrays of distinct slots.

    The size of the model is bounded: at most `max_terms` slots by their own chi-square, and the slots of at most
    `max_pairs` pairs by their interaction, sought among the 4,096 most frequent slots in at least `min_rows` rows.
    """
    n, positive = len(labels), float(labels.sum())
    if not n or positive in (0.0, float(n)):
        share = positive / n if n else 0.0
        return Machine(np.zeros(0, int), 40.0 * (2 * share - 1), np.zeros(0), np.zeros((0, factors)))
    slots = chosen_slots(rows, labels, max_terms, min_chi2, max_pairs, min_pair, min_rows)
    place = np.full(SLOTS, -1)
    place[slots] = np.arange(len(slots))
    x = np.zeros((n, len(slots)), np.float32)
    for i, r in enumerate(rows):
        at = place[r]
        x[i, at[at >= 0]] = 1
    rng = np.random.default_rng(0)
    params = [np.array([np.log(positive / (n - positive))]), np.zeros(len(slots), np.float32), rng.normal(0, 0.01, (len(slots), factors)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        w0, w, v = params
        xv = x @ v
        z = w0 + x @ w + 0.5 * (xv**2 - x @ (v**2)).sum(1)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n
        g = g.astype(np.float32)
        xg = g @ x
        grads = [np.array([g.sum()]), xg + decay / n * w, x.T @ (g[:, None] * xv) - xg[:, None] * v + decay / n * v]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            params[i] = (params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-9)).astype(params[i].dtype)
    return Machine(slots, float(params[0][0]), params[1].astype(float), params[2].astype(float))


def fold(modulus: int, id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> Machine:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Slots()
        for batch in batches:
            rows = [sorted(slots_of(t, cache)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "toxic", "slots"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))), "doc_id")  # max_rows rows
    slots = picked.select("doc_id", "toxic", "text").mapInArrow(extract, "doc_id long, toxic int, slots array<int>")
    # Ids may repeat in `docs`: again at most max_rows rows.
    got = slots.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("slots")).limit(max_rows).toArrow()
    held = got.column("slots").combine_chunks()
    flat, ends = held.values.to_numpy(), held.offsets.to_numpy()
    return fit([flat[a:b] for a, b in zip(ends, ends[1:])], got.column("toxic").to_numpy().astype(float))


class Scorer:
    """Scores of texts; a word's positions among the slots that take part are kept."""

    def __init__(self, machine: Machine):
        self.machine, self.where = machine, {int(s): i for i, s in enumerate(machine.slots)}
        self.known: dict[str, tuple[int, ...]] = {}

    def positions(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= Slots.most:
                self.known.clear()
            found = self.known[word] = tuple(self.where[s] for s in word_slots(word) if s in self.where)
        return found

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        rows = []
        for t in texts:
            found = set().union(*filter(None, map(self.positions, set(WORD.findall((t or "").lower())))))
            rows.append(np.fromiter(found, int, len(found)))
        return 1 / (1 + np.exp(-np.clip(self.machine.logit(rows), -40, 40)))


#: Rows of a batch that are Python strings at one time.
SLICE = 500


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scorer(part.column("text").to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def scored(docs: DataFrame, machine: Machine, threshold: float) -> DataFrame:
    """The rows with a score below the threshold; nothing is joined or shuffled."""
    model, at = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for start in range(0, len(batch), SLICE):
                part = batch.slice(start, SLICE)
                yield part.filter(pa.array(scorer(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, threshold: float = 0.5) -> DataFrame:
    scored = score(docs, train(docs, labels, max_rows))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that the machine doesn't reject, with all their columns. Each row is judged by its own text."""
    return scored(docs, train(docs, labels, max_rows), threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
