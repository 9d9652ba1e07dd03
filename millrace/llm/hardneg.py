"""Hard negatives by the threshold algorithm over sorted lists of each dimension.

The query vectors (anchors) meet all rows block against block. In a block of candidates every
dimension keeps its rows in order of their value. An anchor reads these lists in step, from the top
where its own number is positive and from the bottom where it is negative, so that what it has not
met yet scores at most the threshold: the sum of its numbers times the values last read. Rows met are
scored exactly in integers at once. An anchor stops when the threshold is strictly below the kth score
of each of its windows (or below the window itself), so ties are complete. The best rows of the blocks
are then ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.whitening import finite, vector_rows
from millrace.session import materialise

SCALE = 256
LARGEST = 2.0**16
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
CANDIDATE_BLOCK, ANCHOR_BLOCK = 4096, 512
FIRST_DEPTH = 16
_NO_ID = np.iinfo(np.int64).max


class SortedLists:
    """Integer vectors with the order of their rows in each dimension."""

    def __init__(self, x: np.ndarray):
        self.x = x
        bound = int(np.abs(x).max(initial=0)) ** 2 * x.shape[1]
        self.exact = x.astype(np.float64) if bound < 1 << 53 else x
        self.order = np.argsort(-x, axis=0, kind="stable")
        self.down = np.take_along_axis(x, self.order, axis=0)

    def search(
        self, anchor: np.ndarray, usable: np.ndarray, low: np.ndarray, high: np.ndarray, best: Callable
    ) -> list[np.ndarray]:
        """For each window [low, high] of scores the rows that ``best`` puts first, and no tie left out.

        ``best(rows, scores)`` returns the positions of the first k in final order. ``usable`` tells
        which rows may be returned at all.
        """
        rows = len(self.x)
        wide = int(np.abs(anchor).max(initial=0)) * int(np.abs(self.x).max(initial=0)) * len(anchor) >= 1 << 53
        scored = self.x if wide else self.exact
        query = anchor if wide else anchor.astype(scored.dtype)
        dims = np.flatnonzero(anchor)
        forward = anchor[dims] > 0
        met = ~usable
        held = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in low]
        done, step, open_ = 0, FIRST_DEPTH, list(range(len(low)))
        while open_ and done < rows:
            until = min(rows, done + step)
            near = self.order[done:until, dims[forward]].ravel()
            far = self.order[rows - until : rows - done, dims[~forward]].ravel()
            fresh = np.zeros(rows, dtype=bool)
            fresh[near] = True
            fresh[far] = True
            if not len(dims):
                fresh[:], until = True, rows
            fresh = np.flatnonzero(fresh & ~met)
            met[fresh] = True
            scores = (scored[fresh] @ query).astype(np.int64)
            edge = np.where(forward, self.down[until - 1, dims], self.down[rows - until, dims])
            threshold = int((anchor[dims] * edge).sum())
            left = []
            for w in open_:
                inside = (scores >= low[w]) & (scores <= high[w])
                r = np.concatenate([held[w][0], fresh[inside]])
                s = np.concatenate([held[w][1], scores[inside]])
                first, full = best(r, s)
                held[w] = (r[first], s[first])
                kth = int(held[w][1][-1]) if full else int(low[w])
                if threshold >= kth:
                    left.append(w)
            open_, done, step = left, until, step * 2
        return [h[0] for h in held]


def _first(k: int, ids: np.ndarray, numbers: np.ndarray) -> Callable:
    """Order by falling score, then id, then row number; whether k were found."""

    def best(rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, bool]:
        if len(rows) > 4 * k:
            keep = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        else:
            keep = np.arange(len(rows))
        order = keep[np.lexsort((numbers[rows[keep]], ids[rows[keep]], -scores[keep]))][:k]
        return order, len(order) == k

    return best


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _positive_rows(k: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        anchors, rows = _sides(table)
        out: list[list] = [[] for _ in range(4)]
        labels, anchor_labels = rows["label"].to_numpy(), anchors["label"].to_numpy()
        ids, numbers = _ids(rows["vec_id"]), rows["rid"].to_numpy()
        x, a = _matrix(rows), _matrix(anchors)
        everything = np.array([-(1 << 62)]), np.array([1 << 62])
        for label in np.unique(anchor_labels).tolist():
            own = np.flatnonzero(labels == label)
            if not len(own):
                continue
            lists = SortedLists(x[own])
            best = _first(k, ids[own], numbers[own])
            for n in np.flatnonzero(anchor_labels == label).tolist():
                rid = anchors["rid"][n].as_py()
                (found,) = lists.search(a[n], numbers[own] != rid, *everything, best)
                scores = x[own[found]] @ a[n]
                for place, score in zip(own[found].tolist(), scores.tolist(), strict=True):
                    for column, value in zip(out, (rid, place, int(numbers[place]), score), strict=True):
                        column.append(value)
        return pa.table(
            {
                "rid": pa.array(out[0], pa.int64()),
                "positive_rid": pa.array(out[2], pa.int64()),
                "positive_id": rows["vec_id"].take(pa.array(out[1], pa.int64())),
                "positive_score": pa.array(out[3], pa.int64()),
            }
        )

    return run


def _negative_rows(k: int, low: int, high: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        anchors, rows = _sides(table)
        out: list[list] = [[] for _ in range(5)]
        labels, anchor_labels = rows["label"].to_numpy(), anchors["label"].to_numpy()
        ids, numbers = _ids(rows["vec_id"]), rows["rid"].to_numpy()
        x, a = _matrix(rows), _matrix(anchors)
        lists = SortedLists(x) if len(x) else None
        best = _first(k, ids, numbers)
        for n, positives in enumerate(anchors["scores"].to_pylist()):
            # Windows of equal scores are one.
            points = sorted(set(positives))
            bounds = [(-(-low * p // 100), high * p // 100) for p in points]
            windows = [(p, *b) for p, b in zip(points, bounds, strict=True) if b[0] <= b[1]]
            if lists is None or not windows:
                continue
            edges = np.array([w[1] for w in windows]), np.array([w[2] for w in windows])
            found = lists.search(a[n], labels != anchor_labels[n], *edges, best)
            rid = anchors["rid"][n].as_py()
            for (p, _, _), places in zip(windows, found, strict=True):
                scores = x[places] @ a[n]
                for place, score in zip(places.tolist(), scores.tolist(), strict=True):
                    for column, value in zip(out, (rid, p, place, int(numbers[place]), score), strict=True):
                        column.append(value)
        return pa.table(
            {
                "rid": pa.array(out[0], pa.int64()),
                "positive_score": pa.array(out[1], pa.int64()),
                "negative_rid": pa.array(out[3], pa.int64()),
                "negative_id": rows["vec_id"].take(pa.array(out[2], pa.int64())),
                "negative_score": pa.array(out[4], pa.int64()),
            }
        )

    return run


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    is_anchor = table["is_anchor"]
    return table.filter(is_anchor), table.filter(pa.compute.invert(is_anchor))


def _matrix(side: pa.Table) -> np.ndarray:
    for _, x in vector_rows(side["q"].combine_chunks()):
        return x
    return np.empty((0, 1), dtype=np.int64)


def _blocked(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """Both sides, each repeated for every block of the other; groups (size, row_block, anchor_block)."""
    own = lambda blocks, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.withColumn("scores", F.lit(None).cast("array<bigint>")).withColumn("is_anchor", F.lit(False))
    left = left.withColumn("row_block", own(sizes[0], 5)).withColumn("anchor_block", every(sizes[1]))
    right = anchors.withColumn("is_anchor", F.lit(True))
    right = right.withColumn("anchor_block", own(sizes[1], 7)).withColumn("row_block", every(sizes[0]))
    return left.unionByName(right).groupBy("size", "row_block", "anchor_block")


def _ranked(rows: DataFrame, by: list[str], score: str, id_col: str, rid: str, k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id_col).asc_nulls_last(), rid)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are integer inner products of floor(256 * x). An anchor's positives are its first
    ``positives`` other rows of its label, by falling score, then smaller id; a positive's negatives
    are the first ``negatives`` rows of other labels whose score lies between ``low`` and ``high``
    hundredths of the positive's (so a negative score of a positive has none). ``is_anchor`` is a
    condition on ``vectors``.

    Rows with a null label or a vector that is null, empty or holds null or non-finite numbers take no
    part, nor do entries of 65,536 or more, whose scores might leave a long. Only vectors of equal size
    are compared. A null id is never an anchor and comes last among equal scores. Repeated rows are
    rows of their own: an anchor given twice has its copy as a positive and both return rows. Zero
    vectors score zero. Other columns are left out; no rows give no rows.
    """
    label = F.col("label") if label is None else label
    v = F.col("v")
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        label.cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    rows = rows.where(F.col("label").isNotNull() & finite(v, LARGEST) & (F.size(v) > 0))
    rows = rows.select(
        F.monotonically_increasing_id().alias("rid"),
        "vec_id",
        "label",
        F.size(v).alias("size"),
        (F.col("anchor") & F.col("vec_id").isNotNull()).alias("anchor"),
        F.transform("v", lambda x: F.floor(x * SCALE).cast("bigint")).alias("q"),
    )
    rows = materialise(rows, "integer-vectors")
    total, queries = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    sizes = max(1, math.ceil(total / CANDIDATE_BLOCK)), max(1, math.ceil(queries / ANCHOR_BLOCK))
    plain = ["rid", "vec_id", "label", "size", "q"]
    none = F.lit(None).cast("array<bigint>").alias("scores")
    anchors = rows.where("anchor").select(*plain, none)
    found = _blocked(rows.select(*plain), anchors, sizes).applyInArrow(
        _positive_rows(positives), "rid bigint, positive_rid bigint, positive_id bigint, positive_score bigint"
    )
    found = _ranked(found, ["rid"], "positive_score", "positive_id", "positive_rid", positives).drop("rank")
    found = materialise(found, "positives")
    scores = found.groupBy("rid").agg(F.collect_set("positive_score").alias("scores"))
    anchors = rows.where("anchor").select(*plain).join(scores, "rid").select(*plain, "scores")
    near = _blocked(rows.select(*plain), anchors, sizes).applyInArrow(
        _negative_rows(negatives, low, high),
        "rid bigint, positive_score bigint, negative_rid bigint, negative_id bigint, negative_score bigint",
    )
    near = _ranked(near, ["rid", "positive_score"], "negative_score", "negative_id", "negative_rid", negatives)
    names = rows.where("anchor").select("rid", F.col("vec_id").alias("anchor_id"))
    return (
        found.join(near, ["rid", "positive_score"])
        .join(names, "rid")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
