"""Quality of documents by a factorisation machine.

A document's features are its hashed words (of joint length one), binned statistics of its structure,
and binned metadata. The machine adds a weight per feature and, for each pair of features, the inner
product of their factors. With s = sum of x v and q = sum of (x v)^2 over the features, all pairs
together are half of s^2 - q, summed over the factors: linear in the number of features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, slices

FOLDS, HELD_OUT = 5, 0
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 20_000
THRESHOLD = 0.3
HASH_BITS = 16
FACTORS = 8
BINS = 16
EPOCHS, BATCH, RATE = 40, 64, 0.05
RIDGE_WEIGHTS, RIDGE_FACTORS = 2e-5, 2e-5
SEED = 12
MEMO_ENTRIES = 500_000
LONG_WORD = 64
MARKS = b".,;:?!'\"()-"
METADATA = ("n_chars",)
STATISTICS = (
    "characters", "words", "lines", "upper", "digits", "marks", "symbols", "beyond_ascii", "spaces", "exclaims",
    "distinct_words", "commonest_word", "distinct_lines", "words_a_line", "letters_a_word", "bare_words", "repeats",
)
_CLASS = np.full(256, 5, dtype=np.int64)
for _n, _members in enumerate((range(65, 91), range(97, 123), range(48, 58), MARKS, (9, 10, 11, 12, 13, 32))):
    _CLASS[list(_members)] = _n
_CLASS[128:] = 6


def _log_bin(value: float) -> int:
    return min(BINS - 1, int(np.log2(1 + max(value, 0))))


def _share_bin(part: float, whole: float) -> int:
    """Fine near none and near all, coarse between."""
    p = min(1.0, max(0.0, part / whole)) if whole > 0 else 0.0
    edge = (BINS // 2 - 1) * np.sqrt(2 * min(p, 1 - p))
    return int(edge) if p <= 0.5 else BINS - 1 - int(edge)


def structure(text: str, words: list[str], numbers: np.ndarray) -> list[int]:
    """Bins of the statistics named in STATISTICS; ``numbers`` holds one number per word."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    seen = np.bincount(raw, minlength=256)
    upper, lower, digits, marks, spaces, symbols, beyond = np.bincount(_CLASS, weights=seen, minlength=7)
    total, letters = float(len(raw)), upper + lower + beyond
    counts = np.unique(numbers, return_counts=True)[1] if len(numbers) else np.zeros(1, dtype=np.int64)
    lines = [line for line in text.split("\n") if line]
    bare = sum(map(str.isalpha, words))
    return [
        _log_bin(len(text)),
        _log_bin(len(words)),
        _log_bin(len(lines)),
        _share_bin(upper, letters),
        _share_bin(digits, total),
        _share_bin(marks, total),
        _share_bin(symbols, total),
        _share_bin(beyond, total),
        _share_bin(spaces, total),
        _share_bin(float(seen[33]), total),
        _share_bin(len(counts) if len(numbers) else 0, len(words)),
        _share_bin(float(counts.max()), len(words)),
        _share_bin(len(set(lines)), len(lines)),
        _log_bin(4 * len(words) / max(1, len(lines))),
        _log_bin(4 * letters / max(1, len(words))),
        _share_bin(bare, len(words)),
        _share_bin(int((numbers[1:] == numbers[:-1]).sum()), len(words)),
    ]


class Features:
    """Sparse rows (starts, columns, values) of texts; words already met are remembered."""

    def __init__(self, metadata: int):
        self.metadata = metadata
        self.size = (1 << HASH_BITS) + BINS * len(STATISTICS) + (BINS + 1) * metadata
        self.memo: dict[str, int] = {}

    def _numbers(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        long = []
        for word in set(words):
            if word not in memo:
                memo[word] = zlib.crc32(word.lower().encode("utf-8", "replace")) & ((1 << HASH_BITS) - 1)
                if len(word) > LONG_WORD:
                    long.append(word)
        numbers = np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
        for word in long:
            del memo[word]
        return numbers

    def rows(self, texts: list[str | None], extra: list[list[float | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, columns, values = [0], [], []
        fixed = np.float32(1 / np.sqrt(len(STATISTICS) + self.metadata))
        for row, text in enumerate(texts):
            text = text or ""
            words = text.split()
            numbers = self._numbers(words)
            hashed = np.unique(numbers)
            bins = (1 << HASH_BITS) + BINS * np.arange(len(STATISTICS)) + np.array(structure(text, words, numbers))
            known = [
                (1 << HASH_BITS) + BINS * len(STATISTICS) + (BINS + 1) * k + (BINS if v is None or v != v else _log_bin(v))
                for k, v in enumerate(column[row] for column in extra)
            ]
            columns += [hashed, bins, np.array(known, dtype=np.int64)]
            values.append(np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed))), dtype=np.float32))
            values.append(np.full(len(bins) + len(known), fixed, dtype=np.float32))
            starts.append(starts[-1] + len(hashed) + len(bins) + len(known))
        none = np.empty(0)
        return (
            np.array(starts, dtype=np.int64),
            np.concatenate([*columns, none]).astype(np.int64),
            np.concatenate([*values, none]).astype(np.float32),
        )


@dataclass
class Machine:
    """Bias, weights and factors."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Value of each row before the logistic function; every row has features."""
        if len(starts) < 2:
            return np.empty(0)
        scaled = self.factors[columns] * values[:, None]
        sums = np.add.reduceat(scaled, starts[:-1], axis=0).astype(np.float64)
        squares = np.add.reduceat(scaled * scaled, starts[:-1], axis=0).astype(np.float64)
        single = np.add.reduceat(self.weights[columns] * values, starts[:-1]).astype(np.float64)
        return self.bias + single + 0.5 * (sums * sums - squares).sum(axis=1)


def _logistic(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(
    starts: np.ndarray,
    columns: np.ndarray,
    values: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray,
    size: int,
    epochs: int = EPOCHS,
) -> Machine:
    """Weighted logistic loss by adaptive gradient steps over small batches in a fixed random order."""
    rng = np.random.default_rng(SEED)
    factors = (rng.standard_normal((size, FACTORS)) * 0.05).astype(np.float32)
    share = float(np.average(y, weights=weight))
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size, dtype=np.float32), factors)
    held_w, held_v, held_b = np.full(size, 1e-3, dtype=np.float32), np.full((size, FACTORS), 1e-3, dtype=np.float32), 1e-3
    lengths = np.diff(starts)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            sizes = lengths[rows]
            place = np.repeat(starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            begin = np.concatenate([[0], np.cumsum(sizes)])
            c, x = columns[place], values[place]
            error = (weight[rows] * (_logistic(machine.raw(begin, c, x)) - y[rows]) / len(rows)).astype(np.float32)
            scaled = machine.factors[c] * x[:, None]
            sums = np.add.reduceat(scaled, begin[:-1], axis=0)
            of_row = np.repeat(np.arange(len(rows)), sizes)
            slope = (error[of_row] * x)[:, None] * (sums[of_row] - scaled)
            used, inverse = np.unique(c, return_inverse=True)
            grad_w = np.bincount(inverse, weights=error[of_row] * x).astype(np.float32)
            grad_w += RIDGE_WEIGHTS * machine.weights[used]
            by = np.argsort(inverse, kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(inverse))[:-1]])
            grad_v = np.add.reduceat(slope[by], cuts, axis=0) + RIDGE_FACTORS * machine.factors[used]
            held_w[used] += grad_w**2
            held_v[used] += grad_v**2
            machine.weights[used] -= RATE * grad_w / np.sqrt(held_w[used])
            machine.factors[used] -= RATE * grad_v / np.sqrt(held_v[used])
            slope_b = float(error.sum())
            held_b += slope_b**2
            machine.bias -= RATE * slope_b / np.sqrt(held_b)
    return machine


@dataclass
class Model:
    """A machine, or only the share of label 1 where nothing could be learnt; metadata columns used."""

    machine: Machine | None
    share: float
    metadata: tuple[str, ...]


def labelled_sample(docs: DataFrame, known: DataFrame, sample_rows: int, columns: list) -> DataFrame:
    """At most ``sample_rows`` labelled rows of each class with their columns, one row per id.

    ``known`` (_id, _y) are labels. Ids are drawn first, in the order of a digest; of repeated rows of
    one id the least is taken before the rows leave their tasks, so the sample is bounded by rows.
    """
    lengths = docs.select("_id", F.length("_text").alias("_n"))
    usable = known.join(lengths.where(F.col("_n") <= SAMPLE_CHARS).select("_id").distinct(), "_id", "left_semi")
    order = F.md5(F.col("_id").cast("string"))
    drawn = [usable.where(F.col("_y") == c).orderBy(order, "_id").limit(sample_rows) for c in (0, 1)]
    rows = docs.where(F.length("_text") <= SAMPLE_CHARS).join(F.broadcast(drawn[0].unionByName(drawn[1])), "_id")
    return rows.groupBy("_id", "_y").agg(F.min(F.struct("_text", *columns)).alias("_row"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    metadata: tuple[str, ...] = METADATA,
) -> Model:
    """Learn from labelled rows outside the held-out fold.

    The sample is bounded: ``sample_rows`` documents of each class, the first in the order of a digest
    of their ids, of at most SAMPLE_CHARS characters. Class shares come from all labels and weigh the
    sample. Labels that are null or neither 0 nor 1 are left out; an id labelled 0 and 1 counts as 0.
    ``metadata`` are numeric columns of ``docs``; those that are missing are not used.
    """
    metadata = tuple(m for m in metadata if m in docs.columns)
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & (fold(F.col("_id"), FOLDS) != HELD_OUT))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"))
    number = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    total = sum(number.values())
    share = number.get(1, 0) / total if total else 0.5
    if not 0 < share < 1:
        return Model(None, share, metadata)
    names = [f"_m{k}" for k in range(len(metadata))]
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        *(F.col(m).cast("double").alias(n) for m, n in zip(metadata, names, strict=True)),
    )
    sample = labelled_sample(rows, known, sample_rows, names)
    held = sorted(((r["_id"], r["_y"], *r["_row"]) for r in sample.collect()), key=lambda r: r[0])
    y = np.array([r[1] for r in held], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return Model(None, share, metadata)
    features = Features(len(metadata))
    starts, columns, values = features.rows([r[2] for r in held], [[r[3 + k] for r in held] for k in range(len(names))])
    del held
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(train(starts, columns, values, y, weight, features.size), share, metadata)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per row of ``docs``.

    Null texts count as empty, and empty ones have the statistics of nothing; null metadata is a bin of
    its own. Null ids are in no held-out fold. Repeated rows get equal rows, columns that are not
    metadata of the model are left out, no rows give no rows. Where only one class (or none) could be
    learnt from, every row gets that class's share, 0.5 without any label.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(model.metadata))
        for batch in slices(batches, 64):
            extra = [batch.column(3 + k).to_pylist() for k in range(len(model.metadata))]
            if model.machine is None:
                scores = np.full(batch.num_rows, model.share)
            else:
                scores = _logistic(model.machine.raw(*features.rows(batch.column(2).to_pylist(), extra)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"),
        F.col(text_col).alias("text"),
        *(F.col(m).cast("double").alias(f"_m{k}") for k, m in enumerate(model.metadata)),
    )
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
