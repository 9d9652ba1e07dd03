"""Near-duplicate vectors by p-stable hashing for the Euclidean distance.

A table hashes a normalised vector to K numbers floor((a.v + b) / w) with normal a. Vectors at the
cosine threshold agree on one number with probability p1, orthogonal ones with p2. K makes chance
meetings rare for the number of vectors at hand, and the number of tables then follows from the
recall wanted at the threshold. Candidates are checked by their cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import LIGHT, blocks_of
from millrace.llm.common import components, slices
from millrace.session import materialise

COSINE = 0.93
WIDTH = 2.0
RECALL = 0.999
SEED = 11
_ODD = np.uint64(0x9E3779B97F4A7C15)


def agreement(distance: float, width: float) -> float:
    """Probability that one hash number is equal for two vectors at a Euclidean distance."""
    r = width / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(vectors: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(numbers per table, tables) for so many vectors."""
    p1 = agreement(math.sqrt(2 - 2 * cosine), WIDTH)
    p2 = agreement(math.sqrt(2), WIDTH)
    numbers = max(6, math.ceil(math.log(max(vectors, 2)) / -math.log(p2)))
    return numbers, math.ceil(math.log(1 - recall) / math.log(1 - p1**numbers))


def table_keys(vectors: np.ndarray, numbers: int, tables: int) -> np.ndarray:
    """One 64-bit key per vector and table; vectors are rows of one dimension."""
    size = vectors.shape[1]
    rng = np.random.default_rng((SEED, size))
    directions = rng.standard_normal((size, numbers * tables))
    shift = rng.uniform(0, WIDTH, numbers * tables)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(vectors), tables, numbers)
    keys = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(1), cells.shape[:2]) * _ODD
    for k in range(numbers):
        keys = (keys ^ cells[:, :, k]) * _ODD
        keys = keys ^ (keys >> np.uint64(32))
    return keys.view(np.int64)


def _with_keys(classes: DataFrame, numbers: int, tables: int) -> DataFrame:
    """``classes`` (cid, label, v, m) with an array of table keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            vectors = [np.array(v, dtype=np.float64) for v in batch.column("v").to_pylist()]
            keys: list = [None] * len(vectors)
            for size in {len(v) for v in vectors}:
                rows = [n for n, v in enumerate(vectors) if len(v) == size]
                for n, row in zip(rows, table_keys(np.stack([vectors[n] for n in rows]), numbers, tables), strict=True):
                    keys[n] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names, "keys"]
            )

    kept = classes.select("cid", "label", "v", "m")
    return kept.mapInArrow(run, "cid bigint, label int, v array<double>, m bigint, keys array<bigint>")


def _heavy_links(group: pd.DataFrame) -> pd.DataFrame:
    """Weighted link counts of two blocks' members, and links that connect them as all links do.

    A pair counts only in the first table in which it meets, so no pair counts twice.
    """
    is_left = group["is_left"].to_numpy()
    table = int(group["t"].iloc[0])
    same = bool(is_left.all())
    v = np.stack(group["v"].to_list())
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    keys, weight = np.stack(group["keys"].to_list()), group["m"].to_numpy()
    left = np.flatnonzero(is_left)
    right = left if same else np.flatnonzero(~is_left)
    close = v[left] @ v[right].T >= COSINE
    if same:
        np.fill_diagonal(close, False)
    for t in range(table):
        if not close.any():
            break
        close &= keys[left, t][:, None] != keys[right, t][None, :]
    count, root = np.zeros(len(group), dtype=np.int64), np.arange(len(group))
    count[left] += close @ weight[right]
    if not same:
        count[right] += close.T @ weight[left]
    while True:
        before = root.copy()
        down = np.where(close, root[left][:, None], len(root)).min(axis=0, initial=len(root))
        root[right] = np.minimum(root[right], down)
        across = np.where(close, root[right][None, :], len(root)).min(axis=1, initial=len(root))
        root[left] = np.minimum(root[left], across)
        if (root == before).all():
            break
    cid = group["cid"].to_numpy()
    return pd.DataFrame({"a": cid, "b": cid[root], "n": count})[count > 0]


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    recall: float = RECALL,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``vectors``.

    Vectors link if labels are equal and the cosine is at least COSINE. A null label and a vector
    that is null, empty, zero or holds null or non-finite numbers link with nothing; vectors of
    different sizes do not link either. Equal vectors of a label are one class with a weight.
    Repeated rows link with each other. A null id counts as a link but never names a component.
    Other columns are left out; no rows give no rows.
    """
    v = F.col("v")
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(label_col).cast("int").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    classes = rows.where("ok").groupBy("label", "v").agg(
        F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least")
    )
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    numbers, tables = plan(classes.count(), recall=recall)
    keyed = materialise(_with_keys(classes, numbers, tables), "vector-keys")
    entries = keyed.select("cid", "label", F.posexplode("keys").alias("t", "key"))
    place = ["label", "t", "key"]
    sizes = entries.groupBy(*place).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = materialise(sizes, "bucket-sizes")

    light = entries.join(sizes.where(F.col("size") <= LIGHT), place).select(*place, "cid")
    pairs = (
        light.alias("x")
        .join(light.alias("y"), [F.col(f"x.{p}") == F.col(f"y.{p}") for p in place] + [F.col("x.cid") < F.col("y.cid")])
        .groupBy(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
        .agg(F.min("x.t").alias("t"))
    )
    side = lambda s: keyed.select(F.col("cid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("v", "m", "keys")))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    first = F.array_position(F.zip_with("keys_a", "keys_b", lambda p, q: p == q), True) - 1
    cosine = dot("v_a", "v_b") / F.sqrt(dot("v_a", "v_a")) / F.sqrt(dot("v_b", "v_b"))
    found = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where((F.size("v_a") == F.size("v_b")) & (first == F.col("t")) & (cosine >= COSINE))
        .select("a", "b", "m_a", "m_b")
    )
    found = materialise(found, "light-links")
    each = found.select("a", "b", F.col("m_b").alias("n")).unionByName(
        found.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("m_a").alias("n"))
    )
    heavy = sizes.where(F.col("size") > LIGHT)
    if not heavy.isEmpty():
        blocks = heavy.select(*place, blocks_of(F.col("size")).alias("blocks"))
        own = F.pmod(F.xxhash64("cid", F.lit(17)), F.col("blocks")).cast("int")
        members = (
            entries.join(blocks, place)
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("block_l", F.least("own", "other"))
            .withColumn("block_r", F.greatest("own", "other"))
            .withColumn("is_left", F.col("own") == F.col("block_l"))
            .join(keyed.select("cid", "v", "m", "keys"), "cid")
            .withColumn("size", F.size("v"))
            .select(*place, "block_l", "block_r", "size", "is_left", "cid", "v", "m", "keys")
        )
        forest = members.groupBy(*place, "block_l", "block_r", "size").applyInPandas(
            _heavy_links, "a bigint, b bigint, n bigint"
        )
        each = materialise(each.unionByName(forest), "links")
    counts = each.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(each.select("a", "b")).withColumnRenamed("node", "cid")
    joined = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    known = (
        joined.join(least, "root")
        .join(counts, "cid", "left")
        .select("label", "v", "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    )
    linked = rows.where("ok").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
