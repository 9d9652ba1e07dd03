"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import discard, materialise

SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(key: Column, of: int) -> Column:
    """crc32 of the key's text modulo ``of``; -1 for a null key, which so is in no held-out fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % of, F.lit(-1))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches, so that what a task holds besides a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def with_ids(docs: DataFrame, id_col: str, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose id is (left_semi) or is not (left_anti) a ``doc_id`` of ``rows``.

    Nulls equal each other. The joined column gets a name that ``docs`` does not have.
    """
    name, taken = "_id", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    ids = rows.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids[name]), how)


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each linked node: rows (node, root), roots included.

    ``links`` has two BIGINT columns ``a`` and ``b``; order, repetition and a = b do not matter.
    Large-star and small-star steps alternate until the edge table stays the same. A star's hub
    enters a step only as a minimum (summed before the shuffle) and as a join key that adaptive
    execution may split. Every step's table is written, so that an executor may be lost, and the
    one before is removed.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialise(
        links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        roots = least.select("u", F.col("m").alias("v"))
        after = materialise(small.unionByName(roots).distinct(), "small-star")
        discard(large)
        discard(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    hubs = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.unionByName(hubs)


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free digest of an edge table."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())
