"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are its hashed form (the lexicon), the letter bigrams and trigrams of the word with marks at both ends,
and its first and last three letters; a weight for each feature and language gives the word's emission, and a weight for
each pair of languages the transition. Forward-backward gives every word its probabilities, so a passage in another
language inside a text keeps its own labels; the text's language is the one with the largest mean probability.

Training maximises the likelihood of label sequences of at most 64 words. They come from a sample: for every language value
at most `rows_per_lang` rows of the learning fold, whole texts, at most `max_sequences` sequences in all (those with the
smallest hash). As texts are labelled as a whole, code-switched sequences are made by splicing sequences of different
languages, so that transitions are learned where the language changes too.

Defined cases: a null text or one without a letter (Unicode category L) is `und` with score 0; a null id is in the learning
or held-out fold by the CRC-32 of the empty text; rows with null lang aren't learned from; without any learnable row all
texts are `und`; ties go to the first language in alphabetical order; rows that repeat an id are learned from as they
stand and labelled each; words of any length count whole; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantpanel.llm.common import table
from quantpanel.llm.toxicity import fold

WORD = re.compile(r"[^\W\d_]+")
SLOTS = 1 << 16
STEPS = 64


def slots_of(*letters: np.ndarray) -> np.ndarray:
    """The slots of n-grams, given by their first, second, ... letters."""
    h = np.full(len(letters[0]), len(letters), np.uint64)
    for x in letters:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, offsets): the feature slots of all words in a row, and where each word's begin."""
    marked = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    first, owner = ends - sizes, np.repeat(np.arange(len(words)), sizes)
    lexicon = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    found = [(np.arange(len(words)), slots_of(lexicon + np.uint64(1 << 40)))]
    for n in (2, 3):
        at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        found.append((owner[at], slots_of(*(marked[at + k] for k in range(n)))))
    long = np.flatnonzero(sizes >= 5)
    for at in (first[long], ends[long] - 4):
        found.append((long, slots_of(*(marked[at + k] for k in range(4)))))
    owners, slots = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(owners, kind="stable")
    return slots[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. Fractions, Roman numerals and the like match the pattern, but are no letters."""
    words = WORD.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]


@dataclass
class Field:
    langs: list[str]
    weights: np.ndarray  # slots x languages
    moves: np.ndarray  # languages x languages
    start: np.ndarray


def forward_backward(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """emit: sequences x steps x languages (log). Word probabilities, and the expected moves summed over all sequences."""
    n, steps, k = emit.shape
    e, m = np.exp(emit - emit.max(2, keepdims=True)), np.exp(moves)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = np.exp(start) * e[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[:, t - 1] @ m) * e[:, t]
        alpha[:, t] = a / a.sum(1, keepdims=True)
    live = np.arange(steps)[None, :] < lengths[:, None]
    for t in range(steps - 2, -1, -1):
        b = (beta[:, t + 1] * e[:, t + 1]) @ m.T
        beta[:, t] = np.where(live[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    pairs = np.zeros((k, k))
    if steps > 1:
        left, right = alpha[:, :-1], (beta * e)[:, 1:]
        z = np.einsum("nti,ij,ntj->nt", left, m, right)
        pairs = np.einsum("nti,ntj->ij", left * (live[:, 1:] / z)[:, :, None], right) * m
    return gamma * live[:, :, None], pairs


def spliced(sequences: list[tuple[list[int], int]], seed: int = 0) -> list[tuple[list[int], list[int]]]:
    """Code-switched sequences: stretches of 4 to 24 words from two sequences of different languages in turn."""
    rng, out = np.random.default_rng(seed), []
    order = rng.permutation(len(sequences)).tolist()
    for a, b in zip(order[::2], order[1::2]):
        (left, x), (right, y) = sequences[a], sequences[b]
        if x == y:
            continue
        words, labels, at, side = [], [], [0, 0], int(rng.integers(2))
        while len(words) < STEPS:
            source, label = ((left, x), (right, y))[side]
            take = source[at[side] : at[side] + min(int(rng.integers(4, 25)), STEPS - len(words))]
            if not take:
                break
            words += take
            labels += [label] * len(take)
            at[side] += len(take)
            side = 1 - side
        out.append((words, labels))
    return out


def fit(texts: list[str], langs: list[str], iterations: int = 40, rate: float = 0.15, decay: float = 1e-3) -> Field | None:
    names = sorted(set(langs))
    place: dict[str, int] = {}
    sequences = []
    for text, lang in zip(texts, langs, strict=True):
        ids = [place.setdefault(w, len(place)) for w in words_of(text)]
        sequences += [(ids[i : i + STEPS], names.index(lang)) for i in range(0, len(ids), STEPS)]
    if not sequences:
        return None
    sequences = [(s, [y] * len(s)) for s, y in sequences] + spliced(sequences)
    k, n = len(names), len(sequences)
    lengths = np.array([len(s) for s, _ in sequences])
    grid, y = np.zeros((n, STEPS), int), np.zeros((n, STEPS), int)
    for i, (s, labels) in enumerate(sequences):
        grid[i, : len(s)], y[i, : len(s)] = s, labels
    live = np.arange(STEPS)[None, :] < lengths[:, None]
    flat, offsets = features(list(place))
    owner = np.repeat(np.arange(len(place)), np.diff(offsets))
    truth = (np.eye(k, dtype=np.float32)[y]) * live[:, :, None]
    true_moves = np.bincount((y[:, :-1] * k + y[:, 1:])[live[:, 1:]], minlength=k * k).reshape(k, k).astype(float)
    true_start = np.bincount(y[:, 0], minlength=k).astype(float)
    total = float(lengths.sum())
    params = [np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, iterations + 1):
        weights, moves, start = params
        emit = np.add.reduceat(weights[flat], offsets[:-1])[grid]
        gamma, pairs = forward_backward(emit, lengths, moves, start)
        diff = (gamma - truth)[live]
        by_word = np.stack([np.bincount(grid[live], diff[:, j], len(place)) for j in range(k)], 1)
        by_slot = np.stack([np.bincount(flat, by_word[owner, j], SLOTS) for j in range(k)], 1)
        grads = [by_slot / total + decay / total * weights, (pairs - true_moves) / total + decay * moves, (gamma[:, 0].sum(0) - true_start) / total + decay * start]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g**2
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    return Field(names, params[0], params[1], params[2])


def train(docs: DataFrame, rows_per_lang: int = 150, max_sequences: int = 20_000) -> Field | None:
    known = docs.where(F.col("lang").isNotNull() & (fold(4) != 2)).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows_per_lang)
    # Every row has a sequence at most max_sequences of which are taken, so more rows than that can't matter.
    sample = ranked.orderBy("r", "lang").limit(max_sequences).select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("sample_lang")).distinct()

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                found = [" ".join(words[i : i + STEPS]) for i in range(0, len(words), STEPS)]
                parts += found
                langs += [lang] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.string())], ["lang", "words"])

    same = F.col("doc_id").eqNullSafe(F.col("sample_id")) & (F.col("lang") == F.col("sample_lang"))
    picked = docs.select("doc_id", "lang", "text").join(F.broadcast(sample), same, "left_semi")  # max_sequences rows
    cut_up = picked.select("lang", "text").mapInArrow(sequences, "lang string, words string")
    got = cut_up.orderBy(F.xxhash64("words"), "words", "lang").limit(max_sequences).toArrow()
    return fit(got.column("words").to_pylist(), got.column("lang").to_pylist())


class Places(dict):
    """Word to its number; `new` has those that were given since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Labeller:
    """Emissions of words by a cache; forward-backward over texts of similar length together."""

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.place, self.table = Places(), np.zeros((0, len(self.field.langs)))

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def settle(self) -> None:
        """Emissions of the words that are new since the last call."""
        found = [self.table]
        for at in range(0, len(self.place.new), 20_000):
            slots, offsets = features(self.place.new[at : at + 20_000])
            found.append(np.add.reduceat(self.field.weights[slots], offsets[:-1]))
        self.table = np.concatenate(found)
        self.place.new.clear()

    def probabilities(self, rows: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Of texts with words: their numbers, lengths and word probabilities, some 400,000 words at a time."""
        order = sorted((i for i, r in enumerate(rows) if len(r)), key=lambda i: len(rows[i]))
        while order and len(rows[order[-1]]) > 4 * BLOCK:
            i = order.pop()
            yield [i], np.array([len(rows[i])]), forward_backward_long(self.table[rows[i]], self.field)[None]
        while order:
            take, longest = [], 0
            while order and (not take or (len(take) + 1) * longest <= 400_000):
                longest = max(longest, len(rows[order[-1]]))
                take.append(order.pop())
            lengths = np.array([len(rows[i]) for i in take])
            grid = np.zeros((len(take), longest), int)
            for j, i in enumerate(take):
                grid[j, : lengths[j]] = rows[i]
            yield take, lengths, forward_backward_words(self.table[grid], lengths, self.field)


def forward_backward_words(emit: np.ndarray, lengths: np.ndarray, field: Field) -> np.ndarray:
    """Word probabilities alone; languages are the last axis, steps the first while it runs."""
    e = np.exp(emit - emit.max(2, keepdims=True)).transpose(1, 0, 2).copy()
    m = np.exp(field.moves - field.moves.max())
    back = m.T.copy()
    steps = len(e)
    alpha = np.empty_like(e)
    a = np.exp(field.start - field.start.max()) * e[0]
    alpha[0] = a / a.sum(1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[t - 1] @ m) * e[t]
        a /= a.sum(1, keepdims=True)
        alpha[t] = a
    b = np.ones_like(e[0])
    for t in range(steps - 2, -1, -1):
        b = (b * e[t + 1]) @ back
        b /= b.sum(1, keepdims=True)
        ended = t + 1 >= lengths
        if ended.any():
            b[ended] = 1.0
        alpha[t] *= b
    alpha /= alpha.sum(2, keepdims=True)
    alpha *= (np.arange(steps)[:, None] < lengths[None, :])[:, :, None]
    return alpha.transpose(1, 0, 2)


#: Words of a block of a long text.
BLOCK = 2_048


def forward_backward_long(emit: np.ndarray, field: Field, block: int = BLOCK) -> np.ndarray:
    """Word probabilities of one long text, words x languages, exactly those of the whole chain.

    Blocks of words are worked on side by side: first the matrix that carries a message through each of them, then the
    messages at their ends, block by block, then forward and backward inside all blocks at once.
    """
    n, k = emit.shape
    blocks = -(-n // block)
    e = np.ones((blocks * block, k))
    e[:n] = np.exp(emit - emit.max(1, keepdims=True))
    e = e.reshape(blocks, block, k).transpose(1, 0, 2).copy()
    last = np.minimum(np.arange(1, blocks + 1) * block, n) - np.arange(blocks) * block - 1
    m = np.exp(field.moves - field.moves.max())
    through, inside = np.broadcast_to(np.eye(k), (blocks, k, k)).copy(), np.zeros((blocks, k, k))
    for t in range(block):
        live = (t <= last)[:, None, None]
        inside = np.where(live, through * e[t][:, None, :], inside)
        step = inside @ m
        through = np.where(live, step / step.sum((1, 2), keepdims=True), through)
    into, behind = np.empty((blocks, k)), np.ones((blocks, k))
    x = np.exp(field.start - field.start.max())
    for b in range(blocks):
        into[b] = x
        x = x @ through[b]
        x /= x.sum()
    r = inside[-1].sum(1)
    for b in range(blocks - 2, -1, -1):
        behind[b] = m @ r
        r = through[b] @ r
        r /= r.sum()
    alpha = np.empty_like(e)
    for t in range(block):
        a = (into if t == 0 else alpha[t - 1] @ m) * e[t]
        alpha[t] = a / a.sum(1, keepdims=True)
    beta = behind.copy()
    for t in range(block - 1, -1, -1):
        if t < block - 1:
            beta = np.where((t < last)[:, None], (beta * e[t + 1]) @ m.T, behind)
        beta /= beta.sum(1, keepdims=True)
        alpha[t] *= beta
    alpha /= alpha.sum(2, keepdims=True)
    return alpha.transpose(1, 0, 2).reshape(-1, k)[:n]


def label_words(field: Field, text: str | None) -> list[tuple[str, str, float]]:
    """(word, language, probability) of every word of one text."""
    labeller, words = Labeller(field), words_of(text)
    rows = [labeller.rows(words)]
    labeller.settle()
    return [(w, field.langs[int(p.argmax())], float(p.max())) for _, _, probs in labeller.probabilities(rows) for w, p in zip(words, probs[0], strict=True)]


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        labeller = Labeller(field) if field else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            best, score = ["und"] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts), 4_000) if labeller else ():
                rows = [labeller.rows(words_of(t)) for t in texts[at : at + 4_000]]
                labeller.settle()
                for take, lengths, probs in labeller.probabilities(rows):
                    mean = probs.sum(1) / lengths[:, None]
                    for j, i in enumerate(take):
                        best[at + i], score[at + i] = field.langs[int(mean[j].argmax())], min(1.0, float(mean[j].max()))
                if len(labeller.place) > 200_000:
                    labeller.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
