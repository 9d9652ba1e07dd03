"""Seeded pseudo-random values derived from keys.

They depend on nothing but seed and key, so a retried task, another partitioning or another
engine yields the same order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_md5(seed, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hex_to_unit(digest: Column, offset: int = 0) -> Column:
    """Eight hex digits of a digest as a double in [0, 1)."""
    return F.conv(F.substring(digest, offset * 8 + 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def hex_bucket(digest: Column, digits: int = 3) -> Column:
    """Leading hex digits as an integer: evenly filled, and ordered like the digest itself."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")
