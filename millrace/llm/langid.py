"""Language of texts by a string kernel.

The blended-spectrum presence kernel counts the character n-grams of two to four characters that
two texts share, divided by the root of their numbers of n-grams. Landmark texts give the Nyström
features, kernel ridge regression one weight vector per language on them. As the kernel is linear
in the presence vectors, features and regression fold into one matrix, and a batch of texts is
scored by one product of its presence matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.hashing import hex_to_unit
from millrace.llm.common import fold, slices

FOLDS, HELD_OUT = 4, 2
HASH_BITS = 15
ORDERS = (2, 3, 4)
SAMPLE_ROWS = 2400
SAMPLE_CHARS = 20_000
OVERSAMPLE = 4
LANDMARKS = 192
RIDGE = 1e-3
SHARPNESS = 4.0
UNDETERMINED = "und"
BATCH = 64


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x20000)])


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, everything but letters as a blank, framed by blanks."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    known = np.minimum(codes, 0x1FFFF)
    return np.where(_letters()[known], codes, np.uint32(32))


def has_letters(codes: np.ndarray) -> bool:
    return bool((codes != 32).any())


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash buckets of the n-grams without two blanks in a row, with repetition."""
    blank = codes == 32
    double = blank[1:] & blank[:-1]
    mixed = codes * np.uint32(0x9E3779B1)
    out, value, bad = [], mixed, np.zeros(len(codes), dtype=bool)
    for order in range(2, max(ORDERS) + 1):
        value = (value[:-1] * np.uint32(0x85EBCA6B)) ^ mixed[order - 1 :]
        bad = bad[:-1] | double[order - 2 :]
        if order in ORDERS:
            salted = (value ^ np.uint32(order)) * np.uint32(0xC2B2AE35)
            out.append((salted >> np.uint32(32 - HASH_BITS))[~bad])
    return np.concatenate(out)


def presence(codes: list[np.ndarray]) -> np.ndarray:
    """One row of zeros and ones per text."""
    matrix = np.zeros((len(codes), 1 << HASH_BITS), dtype=np.float32)
    for row, own in zip(matrix, codes, strict=True):
        row[grams(own)] = 1.0
    return matrix


def _root(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(matrix.sum(axis=1, keepdims=True), 1.0))


def train(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression on Nyström features; landmarks alternate languages."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((1 << HASH_BITS, 0), dtype=np.float32))
    queues = {n: [i for i, y in enumerate(languages) if y == n] for n in names}
    turn = sorted((place, n, i) for n in names for place, i in enumerate(queues[n]))
    chosen = [i for _, _, i in turn[:landmarks]]
    base = presence([letter_codes(texts[i]) for i in chosen])
    base /= _root(base)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    to_features = vectors[:, keep] / np.sqrt(values[keep])
    size = int(keep.sum())
    gram, cross = np.zeros((size, size)), np.zeros((size, len(names)))
    share = np.array([len(queues[n]) for n in names], dtype=np.float64)
    for at in range(0, len(texts), 256):
        part = presence([letter_codes(t) for t in texts[at : at + 256]])
        features = (part / _root(part)) @ base.T @ to_features
        labels = np.array([names.index(y) for y in languages[at : at + 256]])
        target = np.where(labels[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
        weight = 1.0 / share[labels]
        gram += (features * weight[:, None]).T @ features
        cross += (features * weight[:, None]).T @ target
    beta = np.linalg.solve(gram + ridge * len(names) * np.eye(size), cross)
    return Model(names, (base.T @ (to_features @ beta)).astype(np.float32))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score (softmax of the regression values) of each text."""
    codes = [letter_codes(t or "") for t in texts]
    lettered = np.array([has_letters(c) for c in codes], dtype=bool)
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    matrix = presence(codes)
    values = SHARPNESS * (matrix @ model.weights / _root(matrix)).astype(np.float64)
    values = np.exp(values - values.max(axis=1, keepdims=True))
    best = values.argmax(axis=1)
    names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
    return names, np.where(lettered, values.max(axis=1) / values.sum(axis=1), 0.0)


def fit(
    docs: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Learn from a bounded sample outside the held-out fold.

    ``sample_rows`` are shared evenly by the languages: of each the first in the order of a digest
    of the id (there are few languages: their counts come to the driver), of texts of at most SAMPLE_CHARS characters.
    Repeated rows of an id in one language count as one. Null languages and texts are left out.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")
    ).where(fold(F.col("_id"), FOLDS) != HELD_OUT)
    rows = rows.where(F.col("_lang").isNotNull() & (F.length("_text") <= SAMPLE_CHARS) & F.col("_id").isNotNull())
    sizes = rows.groupBy(F.col("_lang").alias("_of")).agg(F.count(F.lit(1)).alias("_size"))
    sizes = rows.sparkSession.createDataFrame(sizes.collect(), "_of string, _size bigint")
    each = max(8, sample_rows // max(1, sizes.count()))
    # Of a common language only about OVERSAMPLE times its share of the sample is compared.
    digest = F.md5(F.col("_id").cast("string"))
    drawn = rows.select("_id", "_lang").join(F.broadcast(sizes), F.col("_lang") == F.col("_of"))
    drawn = drawn.where(hex_to_unit(digest) * F.col("_size") < OVERSAMPLE * each)
    order = W.partitionBy("_lang").orderBy(digest, "_id")
    ids = drawn.select("_id", "_lang").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each)
    # Of the rows of one id and language the least text is taken before they leave their tasks.
    chosen = rows.join(F.broadcast(ids.select("_id", "_lang")), ["_id", "_lang"])
    sample = chosen.groupBy("_id", "_lang").agg(F.min("_text").alias("_text")).collect()
    sample = sorted((r["_id"], r["_lang"], r["_text"]) for r in sample)
    return train([r[2] for r in sample], [r[1] for r in sample])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row of ``docs``.

    Texts that are null or have no letter are ``und`` with score 0, as all are if nothing could be
    learnt. Null ids are in no held-out fold, repeated rows give equal rows, other columns are left
    out, no rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH):
            names, scores = predict(model, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
