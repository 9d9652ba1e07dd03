"""Compare the members of buckets of any size without emitting all pairs of a bucket.

Buckets with few members are joined in the plan. The others are cut into blocks of a fixed size
by a digest of the member; each pair of blocks is one small group, and a group returns as many
rows as it has members, not as many as it has pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIGHT = 32
BLOCK = 1024


def blocks_of(count: Column, size: int = BLOCK) -> Column:
    return F.ceil(count / size).cast("int")


def block_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], digest: str, sizes: DataFrame
) -> DataFrame:
    """Rows of both sides, repeated for every block of the other side.

    ``sizes`` has one row per bucket: keys, ``left_blocks`` and ``right_blocks``. The result adds
    ``block_l``, ``block_r`` and ``is_left``; (keys, block_l, block_r) is a group of about two
    blocks' rows.
    """

    def spread(side: DataFrame, own: str, other: str, is_left: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.col(digest), F.lit(17)), F.col(f"{own}_blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        names = ("block_l", "block_r") if is_left else ("block_r", "block_l")
        return (
            side.join(sizes, keys)
            .withColumn(names[0], mine)
            .withColumn(names[1], every)
            .withColumn("is_left", F.lit(is_left))
            .drop("left_blocks", "right_blocks")
        )

    return spread(left, "left", "right", True).unionByName(spread(right, "right", "left", False))
