"""Global row numbers and running totals without a single-task window.

Each operator works in three steps: rows get an ordered bucket, the buckets' totals form a small
table whose prefix sums are the buckets' offsets, and a window inside the bucket adds the rest.
Buckets are chosen so that no key value decides their size: quantiles of a unique key, or the
leading digits of a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.hashing import hex_bucket, seeded_md5

ROWS_PER_BUCKET = 20_000
MIN_BUCKET = 500
MAX_BUCKETS = 65_536
FINE_STEP = 256


def quantile_bounds(df: DataFrame, key: str) -> list[float]:
    """Split points of a numeric key, at most MAX_BUCKETS - 1 values, from one narrow pass.

    They are fixed as literals so that both reads of the rows see the same buckets.
    """
    rows = df.agg(F.count(key)).first()[0]
    cores = df.sparkSession.sparkContext.defaultParallelism
    buckets = max(-(-rows // ROWS_PER_BUCKET), min(cores, rows // MIN_BUCKET))
    buckets = min(MAX_BUCKETS, buckets)
    if buckets <= 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    accuracy = max(10_000, 4 * buckets)
    found = df.agg(F.percentile_approx(key, shares, accuracy).alias("q")).first()["q"]
    return sorted(set(found))


def constant_array(values: list) -> Column:
    """Numbers as one literal that the optimizer folds, however many they are."""
    listed = F.split(F.lit(",".join(map(str, values))), ",")
    return listed.cast("array<double>" if isinstance(values[0], float) else "array<bigint>")


def bucket_of(key: Column, bounds: list[float]) -> Column:
    """How many bounds are at or below the key: a coarse look-up, then one within FINE_STEP."""
    if not bounds:
        return F.lit(0)
    if len(bounds) <= FINE_STEP:
        return F.size(F.filter(constant_array(bounds), lambda b: b <= key))
    first_of_step = constant_array(bounds[::FINE_STEP])
    step = F.greatest(F.size(F.filter(first_of_step, lambda b: b <= key)) - 1, F.lit(0))
    fine = F.slice(constant_array(bounds), step * FINE_STEP + 1, F.lit(FINE_STEP))
    return step * FINE_STEP + F.size(F.filter(fine, lambda b: b <= key))


def running_total(
    df: DataFrame,
    order: str,
    value: Column,
    name: str,
    within: tuple[str, ...] = (),
    bucket: Column | None = None,
    total: str | None = None,
    bounded: bool = True,
) -> DataFrame:
    """Running sum of a BIGINT value up to and including each row, per group of ``within``.

    ``order`` must be unique inside a group. A group of any size is spread over its buckets.
    ``total`` names a column for the group's whole sum. ``bounded`` says that the caller's buckets
    are at most MAX_BUCKETS.
    """
    if bucket is None:
        bucket = bucket_of(F.col(order), quantile_bounds(df, order))
    keys = [*within, "_bucket"]
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("bigint"))
    sums = rows.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    # One row per group and bucket. Without groups that is at most MAX_BUCKETS rows.
    group = W.partitionBy(*(F.col(k) for k in within)) if within else W.partitionBy(F.lit(0))
    before = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(group).alias("_total"),
    )
    # Only a table of at most MAX_BUCKETS rows is broadcast by hint; a null key is a group too.
    offsets = offsets.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_offset", "_total")
    if not within and bounded:
        offsets = F.broadcast(offsets)
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    inside = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(offsets, same).withColumn(
        name, F.col("_offset") + F.sum("_value").over(inside)
    ).drop(*(f"_of_{k}" for k in keys))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_bucket", "_value", "_sum", "_offset", "_total")


def row_index(
    df: DataFrame, order: str, name: str = "rn", within: tuple[str, ...] = (), total: str | None = None
) -> DataFrame:
    """1-based position of each row in the order of a unique numeric column."""
    return running_total(df, order, F.lit(1), name, within, total=total)


def cut_points(df: DataFrame, key: str, every: int) -> list[int]:
    """Keys that begin the second and each later group of ``every`` rows in the order of a unique key.

    Only the key is shuffled, and one number per group reaches the driver. With ``bucket_of`` they
    tell each row's group without moving the row.
    """
    placed = row_index(df.select(key), key, "_rn").where((F.col("_rn") > 1) & ((F.col("_rn") - 1) % every == 0))
    return sorted(r[0] for r in placed.select(key).collect())


def digits_for(rows: int) -> int:
    """Leading hex digits that cut so many rows into buckets of ROWS_PER_BUCKET."""
    digits = 1
    while 16**digits * ROWS_PER_BUCKET < rows:
        digits += 1
    return digits


def shuffled_index(
    df: DataFrame, seed, *ids: str, name: str = "pos", total: str | None = None, digits: int | None = None
) -> DataFrame:
    """1-based position of each row in a seeded random order of its id columns.

    The number of buckets follows the number of rows; one narrow pass counts them.
    """
    digits = digits or digits_for(df.count())
    keyed = df.withColumn("_md5", seeded_md5(seed, *[F.col(i) for i in ids]))
    bucket = hex_bucket(F.col("_md5"), digits)
    bounded = 16**digits <= MAX_BUCKETS
    return running_total(keyed, "_md5", F.lit(1), name, bucket=bucket, total=total, bounded=bounded).drop("_md5")


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Hash partitions by a key, as many as the session's shuffle setting says.

    A number that is spelled out keeps adaptive execution from merging partitions by their
    bytes: what follows costs far more than reading them.
    """
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(number, F.col(key))


def overlapping_chunks(
    df: DataFrame, index: str, chunk_rows: int, back: int
) -> DataFrame:
    """Copy the last ``back`` rows of every chunk into the next, marked ``_own = false``.

    A trailing frame of up to ``back`` rows can then be computed chunk by chunk, whatever the
    size of the series.
    """
    home = F.floor((F.col(index) - 1) / chunk_rows)
    offset = (F.col(index) - 1) % chunk_rows
    chunks = F.when(
        offset >= chunk_rows - back, F.array(home, home + 1)
    ).otherwise(F.array(home))
    return df.withColumn("_chunk", F.explode(chunks)).withColumn("_own", F.col("_chunk") == home)
