"""Toxicity of documents from tagged spans."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, slices, with_ids
from millrace.llm.crf import BUCKETS, WORD, Chain, Lexicon, Tagger, train

FOLDS, HELD_OUT = 4, 2
SAMPLE_ROWS = 1200
CLEAN_FOR_TOXIC = 2
SAMPLE_CHARS = 20_000
THRESHOLD = 0.3
SPAN_MARGINAL = 0.5
LEAST_MARGINAL = 0.2
MIN_LIFT = 8.0


@dataclass
class Model:
    """The chain and the logistic weights over a document's summary of marginals."""

    chain: Chain
    weights: np.ndarray


def summary(marginals: np.ndarray) -> np.ndarray:
    """Expected number of toxic tokens (log), the largest marginal, their share, a constant.

    Marginals below LEAST_MARGINAL do not add up, however long a text is.
    """
    if not len(marginals):
        return np.array([0.0, 0.0, 0.0, 1.0])
    total = float(marginals[marginals >= LEAST_MARGINAL].sum())
    return np.array([np.log1p(total), float(marginals.max()), total / len(marginals), 1.0])


def _sketch(text: np.ndarray) -> int:
    """Smallest digest of the text's runs of five words: equal for most pairs of near copies."""
    if len(text) < 5:
        return zlib.crc32(text.tobytes())
    runs = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint64), 5)
    mixed = np.zeros(len(runs), dtype=np.uint64)
    for column in runs.T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return int(mixed.min())


def token_labels(lexicon: Lexicon, labels: list[int]) -> list[np.ndarray]:
    """Token labels from document labels.

    A token of a toxic document is toxic if one of its features occurs in toxic documents more
    often than chance allows: its binomial divergence from the classes' shares must exceed the
    log of the number of words by five, and its odds must rise by MIN_LIFT. Near copies, told by a
    common sketch, count once.
    """
    groups: dict[tuple[int, int], list[int]] = {}
    for n, (text, label) in enumerate(zip(lexicon.texts, labels, strict=True)):
        groups.setdefault((_sketch(text), label), []).append(n)
    seen, number = np.zeros((2, BUCKETS + 1)), np.zeros(2)
    for (_, label), members in groups.items():
        words = np.unique(np.concatenate([lexicon.texts[n] for n in members]))
        seen[label][np.unique(lexicon.features[words])] += 1
        number[label] += 1
    number = np.maximum(number, 1)
    share = number[1] / number.sum()
    clean, toxic = seen
    n = np.maximum(clean + toxic, 1)
    q = toxic / n
    with np.errstate(divide="ignore", invalid="ignore"):
        divergence = np.where(q > 0, q * np.log(q / share), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0)
    lift = (toxic + 0.5) / (number[1] + 1) / ((clean + 0.5) / (number[0] + 1))
    strong = (lift >= MIN_LIFT) & (n * divergence > np.log(len(lexicon.words) + 1) + 5)
    strong[BUCKETS] = False
    toxic_word = strong[lexicon.features].any(axis=1)
    return [toxic_word[text] & bool(label) for text, label in zip(lexicon.texts, labels, strict=True)]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * len(y) * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(x.shape[1])
        beta += np.linalg.solve(bend, slope)
    return beta


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Learn from labelled documents outside the held-out fold.

    The sample is bounded: at most ``sample_rows`` toxic documents and CLEAN_FOR_TOXIC times as
    many clean ones, the first in the order of
    a digest of their ids, of at most SAMPLE_CHARS characters each; of repeated rows of an id the one
    with the least text. An id labelled 0 and 1 counts as 0. Class shares come from all labels. Without a
    class of labels every document gets the share of the other.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    known = known.where(F.col("_toxic").isin(0, 1) & F.col("_id").isNotNull())
    known = known.where(fold(F.col("_id"), FOLDS) != HELD_OUT).groupBy("_id").agg(F.min("_toxic").alias("_toxic"))
    number = {r[0]: r[1] for r in known.groupBy("_toxic").count().collect()}
    total = sum(number.values())
    if number.get(0, 0) == 0 or number.get(1, 0) == 0:
        odds = 0.0 if not total else (8.0 if number.get(1) else -8.0)
        return Model(train(Lexicon([]), []), np.array([0.0, 0.0, 0.0, odds]))
    order = F.md5(F.col("_id").cast("string"))
    lengths = docs.select(F.col(id_col).alias("_id"), F.length(text_col).alias("_n"))
    usable = known.join(lengths.where(F.col("_n") <= SAMPLE_CHARS).select("_id").distinct(), "_id", "left_semi")
    chosen = [
        usable.where(F.col("_toxic") == c).orderBy(order, "_id").limit(n)
        for c, n in enumerate((CLEAN_FOR_TOXIC * sample_rows, sample_rows))
    ]
    ids = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.where(F.length("_text") <= SAMPLE_CHARS).join(F.broadcast(ids), "_id")
    rows = rows.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    sample = sorted((r["_id"], r["_toxic"], r["_text"]) for r in rows.collect())
    y = [r[1] for r in sample]
    if len(set(y)) < 2:
        share = number[1] / total
        return Model(train(Lexicon([]), []), np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))]))
    texts = [r[2] for r in sample]
    del sample
    lexicon = Lexicon(texts)
    chain = train(lexicon, token_labels(lexicon, y))
    del lexicon
    tagger, x = Tagger(chain), []
    for at in range(0, len(texts), 128):
        x += [summary(m) for m in tagger.tag(texts[at : at + 128])]
    x = np.stack(x)
    y = np.array(y, dtype=np.float64)
    shares = np.array([number[0], number[1]]) / total
    drawn = np.array([(y == 0).mean(), (y == 1).mean()])
    return Model(chain, _logistic(x, y, (shares / drawn)[y.astype(int)]))


def spans_of(text: str, marginals: np.ndarray) -> str:
    """Offsets start:end, in characters, of the runs of tokens with a marginal over a half."""
    out, last = [], -2
    for number, match in enumerate(WORD.finditer(text)):
        if marginals[number] > SPAN_MARGINAL:
            if last == number - 1:
                out[-1] = (out[-1][0], match.end())
            else:
                out.append(match.span())
            last = number
    return ",".join(f"{a}:{b}" for a, b in out)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, spans), one per row of ``docs``.

    ``spans`` are the offending offsets in characters. Null and empty texts get the score of a
    document without tokens. Null ids are in no held-out fold. Repeated rows get equal rows,
    other columns are left out, no rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.chain)
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            tagged = tagger.tag(texts)
            x = np.stack([summary(m) for m in tagged])
            scores = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            spans = [
                spans_of(t, m) if len(m) and m.max() > SPAN_MARGINAL else ""
                for t, m in zip(texts, tagged, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(scores),
                    pa.array((scores >= THRESHOLD).astype(np.int32)),
                    pa.array(spans, pa.string()),
                ],
                ["doc_id", "held_out", "score", "predicted", "spans"],
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(
        run, "doc_id bigint, held_out boolean, score double, predicted int, spans string"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns; equal ids go together.

    All rows stay where texts of both classes were not to be had, so that nothing could be learnt. A
    null id goes if any row with a null id is toxic; null and empty texts have no toxic token. Columns of
    any name are kept as they are; no rows give no rows.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    if not model.weights[:-1].any():
        return docs
    return with_ids(docs, id_col, score(docs, model, id_col, text_col).where("predicted = 1"), "left_anti")
