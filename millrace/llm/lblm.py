"""Log-bilinear language model with noise-contrastive estimation.

The softmax has two levels. The commonest words and the text's end are classes of their own, the
other hot words are grouped into learnt classes, and the words that are not hot share the last one;
inside a class words follow their counts. A token's class is predicted from the two classes before
it: a linear map of their vectors is compared with every class vector, and a softmax over all
classes normalises.

What the model learns from is counted over all training texts: word counts (a table that grows
with the corpus and stays distributed), how often the PILLARS commonest words stand within REACH
tokens of each hot word (a row of PILLARS numbers per hot word), and counts of class triples, at
most CLASSES * (CLASSES + 1)^2. The last two are bounded by their kind and come to the driver, where
numpy groups the words and trains; the number of steps grows with the training tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, slices
from millrace.session import materialise

FOLDS, HELD_OUT = 7, 2
CLASSES = 128
OWN = 62
HOT_WORDS = 49_152
PILLARS = 96
REACH = 8
GROUP_ROUNDS = 12
SIZE = 32
NOISE = 16
BATCH = 4096
STEPS_A_DOUBLING = 60
RATE = 0.3
FLUSH = 400_000
PENDING = 2_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


@dataclass
class Vocabulary:
    """Hot words by falling count, and totals over all training tokens, ends included.

    Word n of ``hot`` has class n below OWN and a learnt class from there on; CLASSES - 2 is the end,
    CLASSES - 1 every word that is not hot, CLASSES (as context only) the text's start. ``classes``
    holds the class of each hot word and, last, of a word that is not hot.
    """

    hot: dict[bytes, int]
    counts: np.ndarray
    ends: int
    n_tokens: int
    n_distinct: int
    n_rare: int
    rare_distinct: int
    least_hot: int
    classes: np.ndarray

    def shares(self) -> np.ndarray:
        """Log10 share of each hot word in its class and, last, 0 for a word that is not hot."""
        whole = np.bincount(self.classes[:-1], weights=self.counts, minlength=CLASSES)
        return np.append(np.log10(self.counts / whole[self.classes[:-1]]), 0.0)


def _sum_rows(counter: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], ["word", "c"]
    )


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, c) over the column ``text`` (binary)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counter.update(tokens(text))
            if len(counter) >= FLUSH:
                yield _sum_rows(counter)
                counter = Counter()
        yield _sum_rows(counter)

    rows = texts.select("text").mapInArrow(run, "word binary, c bigint")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, n_texts: int, hot_words: int = HOT_WORDS) -> Vocabulary:
    """The hot words are all above the smallest count bin that keeps them at most ``hot_words``."""
    level = F.floor(F.log2("c") * 8)
    bins = counts.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")
    )
    found = sorted(bins.collect(), key=lambda r: -r["level"])
    kept, least = 0, 1 << 62
    for row in found:
        if kept + row["n"] > hot_words:
            break
        kept, least = kept + row["n"], row["least"]
    hot = sorted((-r["c"], bytes(r["word"])) for r in counts.where(F.col("c") >= least).collect())
    numbers = np.array([-c for c, _ in hot], dtype=np.int64)
    total, distinct = sum(r["c"] for r in found), sum(r["n"] for r in found)
    return Vocabulary(
        {w: n for n, (_, w) in enumerate(hot)},
        numbers,
        n_texts,
        total + n_texts,
        distinct + (n_texts > 0),
        total - int(numbers.sum()),
        distinct - len(hot),
        least,
        np.append(np.minimum(np.arange(len(hot)), OWN), CLASSES - 1),
    )


class Reader:
    """Turns texts into hot word numbers and classes."""

    def __init__(self, vocab: Vocabulary):
        self.hot, self.classes, self.cold = vocab.hot, vocab.classes, len(vocab.counts)

    def read(self, texts: list[bytes | None]) -> tuple[list[list[bytes]], list[np.ndarray]]:
        words = [tokens(t) for t in texts]
        get, cold = self.hot.get, self.cold
        return words, [np.array([get(w, cold) for w in ws], dtype=np.int64) for ws in words]

    def contexts(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Contexts (two classes packed) and classes of all tokens, each text with its end."""
        start, end = np.full(2, CLASSES), np.array([CLASSES - 2])
        line = np.concatenate([np.concatenate([start, self.classes[n], end]) for n in numbers])
        context = line[:-2] * (CLASSES + 1) + line[1:-1]
        target = line[2:]
        real = target != CLASSES
        # A text's first start follows another text: both start places are no targets.
        return context[real], target[real]


def neighbour_counts(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Rows (word, p0, p1, ...): how often each pillar stands near a hot word, over all texts.

    A task adds up a table of hot words by pillars and returns its rows that are not all zero.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocab)
    names = [f"p{n}" for n in range(PILLARS)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        total = np.zeros((reader.cold + 1) * PILLARS, dtype=np.int64)
        pending: list[np.ndarray] = []

        def add(least: int) -> None:
            if sum(map(len, pending)) > least:
                total[:] += np.bincount(np.concatenate(pending), minlength=len(total))
                pending.clear()

        gap = np.full(REACH, -1)
        for batch in slices(batches):
            _, numbers = reader.read(batch.column(0).to_pylist())
            line = np.concatenate([gap, *(part for n in numbers for part in (n, gap))])
            places = np.flatnonzero((line >= 0) & (line < PILLARS))
            for step in [*range(-REACH, 0), *range(1, REACH + 1)]:
                near = line[places + step]
                pending.append(near[near >= 0] * PILLARS + line[places[near >= 0]])
                add(PENDING)
        add(0)
        table = total.reshape(-1, PILLARS)[:-1]
        seen = np.flatnonzero(table.any(axis=1))
        for at in range(0, len(seen), 8192):
            part = seen[at : at + 8192]
            columns = [pa.array(part), *(pa.array(np.ascontiguousarray(table[part, n])) for n in range(PILLARS))]
            yield pa.RecordBatch.from_arrays(columns, ["word", *names])

    rows = texts.select("text").mapInArrow(run, "word bigint, " + ", ".join(f"{n} bigint" for n in names))
    return rows.groupBy("word").agg(*(F.sum(n).alias(n) for n in names))


def group_words(table: np.ndarray, groups: int, seed: int = 3) -> np.ndarray:
    """Group the rows of a table of neighbour counts, commonest words first: a number per row.

    Each group is a distribution over pillars, each row goes where its counts are likeliest, in
    turns. Rows without counts form the last group. The first centres are drawn from the first 4,096
    rows, each by its squared distance to the nearest centre before it.
    """
    out = np.full(len(table), groups - 1)
    filled = np.flatnonzero(table.any(axis=1))
    if not len(filled) or groups < 2:
        return out
    rng = np.random.default_rng(seed)
    counts = table[filled].astype(np.float32)
    roots = np.sqrt(counts[:4096] / counts[:4096].sum(axis=1, keepdims=True))
    chosen = [0]
    far = np.maximum(1 - roots @ roots[0], 0).astype(np.float64)
    while len(chosen) < groups - 1 and far.sum() > 1e-9:
        mass = np.cumsum(far)
        chosen.append(min(int(np.searchsorted(mass, rng.random() * mass[-1], "right")), len(far) - 1))
        far = np.minimum(far, np.maximum(1 - roots @ roots[chosen[-1]], 0))
    overall = counts.sum(axis=0, dtype=np.float64) + 1e-9
    overall /= overall.sum()
    centres = counts[chosen].astype(np.float64)
    for _ in range(GROUP_ROUNDS):
        smooth = centres + 20 * overall
        smooth /= smooth.sum(axis=1, keepdims=True)
        own = (counts @ np.log(smooth).astype(np.float32).T).argmax(axis=1)
        centres = np.stack([counts[own == k].sum(axis=0, dtype=np.float64) for k in range(len(chosen))])
    out[filled] = own
    return out


def with_classes(vocab: Vocabulary, texts: DataFrame) -> Vocabulary:
    """The vocabulary with its hot words beyond OWN in learnt classes."""
    more = len(vocab.counts) - OWN
    if more <= 0:
        return vocab
    found = neighbour_counts(texts, vocab).toArrow()
    table = np.zeros((len(vocab.counts), PILLARS), dtype=np.int64)
    places = found.column(0).to_numpy()
    for n in range(PILLARS):
        table[places, n] = found.column(n + 1).to_numpy()
    classes = vocab.classes.copy()
    classes[OWN:-1] = OWN + group_words(table[OWN:], CLASSES - 2 - OWN)
    return replace(vocab, classes=classes)


def triple_counts(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Rows (code, n): how often a class follows two others, over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        total = np.zeros(CLASSES * (CLASSES + 1) ** 2, dtype=np.int64)
        for batch in slices(batches):
            _, numbers = reader.read(batch.column(0).to_pylist())
            context, target = reader.contexts(numbers)
            codes, n = np.unique(context * CLASSES + target, return_counts=True)
            total[codes] += n
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 200_000):
            part = seen[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["code", "n"])

    return texts.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    context: np.ndarray  # a vector per class and the start, for the place before and the one before that
    words: np.ndarray
    bias: np.ndarray

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """Natural log of the normalised class probabilities, one row per packed context."""
        hidden = self.context[0][contexts // (CLASSES + 1)] + self.context[1][contexts % (CLASSES + 1)]
        scores = hidden @ self.words.T + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def train(codes: np.ndarray, numbers: np.ndarray, steps: int, seed: int = 5) -> Model:
    """Noise-contrastive estimation: each drawn triple against NOISE classes drawn by frequency."""
    rng = np.random.default_rng(seed)
    unigram = np.bincount(codes % CLASSES, weights=numbers, minlength=CLASSES) + 1.0
    noise = unigram / unigram.sum()
    vectors = rng.normal(0, 0.1, (CLASSES + 1, SIZE)).astype(np.float32)
    maps = [np.eye(SIZE, dtype=np.float32) * 0.5 for _ in range(2)]
    words = rng.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32)
    bias = np.log(noise).astype(np.float32)
    log_noise = np.log(NOISE * noise).astype(np.float32)
    values = [vectors, *maps, words, bias]
    past = [np.full_like(v, 1e-3) for v in values]
    mass = np.cumsum(numbers.astype(np.float64))
    noise_mass = np.cumsum(noise)
    for step in range(steps if len(codes) else 0):
        drawn = codes[np.minimum(np.searchsorted(mass, rng.random(BATCH) * mass[-1], "right"), len(codes) - 1)]
        target, context = drawn % CLASSES, drawn // CLASSES
        far, near = context // (CLASSES + 1), context % (CLASSES + 1)
        hidden = vectors[far] @ maps[0] + vectors[near] @ maps[1]
        other = np.minimum(np.searchsorted(noise_mass, rng.random((BATCH, NOISE)), "right"), CLASSES - 1)
        odds = hidden @ words.T + bias - log_noise
        real = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        rows = np.arange(BATCH)
        drawn_noise = np.bincount((rows[:, None] * CLASSES + other).ravel(), minlength=BATCH * CLASSES)
        slope = -drawn_noise.reshape(BATCH, CLASSES) * real
        slope[rows, target] += 1 - real[rows, target]
        slope = slope.astype(np.float32) / BATCH
        to_hidden = slope @ words
        ones = np.zeros((2, BATCH, CLASSES + 1), dtype=np.float32)
        ones[0, rows, far] = 1
        ones[1, rows, near] = 1
        slopes = [
            ones[0].T @ (to_hidden @ maps[0].T) + ones[1].T @ (to_hidden @ maps[1].T),
            vectors[far].T @ to_hidden,
            vectors[near].T @ to_hidden,
            slope.T @ hidden,
            slope.sum(axis=0),
        ]
        rate = RATE * (1 - step / steps) ** 0.5
        for value, gradient, square in zip(values, slopes, past, strict=True):
            square += gradient * gradient
            value += rate * gradient / np.sqrt(square)
    return Model(np.stack([vectors @ maps[0], vectors @ maps[1]]), words, bias)


def _parts(rows: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """Per text what the model and the hot words give, and its other words with their numbers."""
    shared = rows.sparkSession.sparkContext.broadcast((vocab, model))
    schema = (
        "doc_id bigint, held_out boolean, row bigint, n_tokens bigint, n_known bigint, hot_log double, "
        "n_cold bigint, share_log double, class_log double, cold array<struct<word:binary,n:bigint>>"
    )
    cold_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        reader = Reader(vocab)
        log_count = np.append(np.log10(vocab.counts + 1.0), 0.0)
        end_log = float(np.log10(vocab.ends + 1.0))
        share_log = vocab.shares()
        row = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            words, numbers = reader.read(batch.column(2).to_pylist())
            context, target = reader.contexts(numbers)
            distinct, place = np.unique(context, return_inverse=True)
            logs = model.log_probabilities(distinct)[place, target] / np.log(10)
            sizes = np.array([len(n) + 1 for n in numbers])
            cuts = np.cumsum(sizes) - sizes
            columns: list[list] = [[] for _ in range(6)]
            for ws, own in zip(words, numbers, strict=True):
                hot = own < reader.cold
                cold = Counter(w for w, h in zip(ws, hot.tolist(), strict=True) if not h) if not hot.all() else {}
                values = (
                    int(hot.sum()) + (vocab.ends > 0),
                    float(log_count[own].sum()) + end_log,
                    len(own) - int(hot.sum()),
                    float(share_log[own].sum()),
                    [{"word": w, "n": n} for w, n in cold.items()],
                )
                for column, value in zip(columns, values, strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(range(row, row + batch.num_rows), pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.float64()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.float64()),
                    pa.array(np.add.reduceat(logs, cuts), pa.float64()),
                    pa.array(columns[4], cold_type),
                ],
                ["doc_id", "held_out", "row", "n_tokens", "n_known", "hot_log", "n_cold", "share_log", "class_log", "cold"],
            )
            row += batch.num_rows

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_words: int = HOT_WORDS,
    steps: int | None = None,
) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per row.

    Training texts are those outside the held-out fold. Without ``steps`` there are STEPS_A_DOUBLING for
    each doubling of the training tokens. ``base_score`` is the add-one unigram
    model's log10 probability of the text, ``score`` this model's. Null and empty texts are an end
    token only. Null ids are in no held-out fold. Repeated rows are scored each (and counted each),
    other columns are left out, no rows give no rows; without training texts all words are unknown
    and all classes come from the untrained model.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"),
        F.col(text_col).cast("binary").alias("text"),
    )
    training = rows.where("not held_out")
    counts = materialise(word_counts(training), "word-counts")
    vocab = with_classes(vocabulary(counts, training.count(), hot_words), training)
    triples = triple_counts(training, vocab).toArrow()
    codes, numbers = triples.column(0).to_numpy(), triples.column(1).to_numpy()
    order = np.argsort(codes)
    steps = round(STEPS_A_DOUBLING * np.log2(vocab.n_tokens + 1)) if steps is None else steps
    model = train(codes[order], numbers[order], steps)
    parts = materialise(_parts(rows, vocab, model), "scored-parts")
    cold = parts.select("row", F.explode("cold").alias("w")).select("row", "w.word", "w.n")
    rest = counts.where(F.col("c") < vocab.least_hot)
    c = F.coalesce("c", F.lit(0))
    cold = (
        cold.join(rest, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("cold_known"),
            F.sum(F.col("n") * F.log10(c + 1.0)).alias("cold_log"),
        )
    )
    known, cold_log = F.coalesce("cold_known", F.lit(0)), F.coalesce("cold_log", F.lit(0.0))
    n, v = vocab.n_tokens, vocab.n_distinct
    per_token = float(np.log10(n + 1 * (v + 1)))
    per_rare = float(np.log10(vocab.n_rare + vocab.rare_distinct + 1))
    return parts.drop("cold").join(cold, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("hot_log") + cold_log - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("class_log") + F.col("share_log") + cold_log - F.col("n_cold") * per_rare).alias("score"),
    )
