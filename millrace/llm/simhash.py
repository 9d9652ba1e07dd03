"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. The perfect binary Golay code
assigns each segment (filled up to 23 bits) to one of 4,096 codewords at distance three or less.
Of two fingerprints that differ in at most three bits either one segment is equal and another differs
in at most one bit, or all three segments differ in one bit each. For the first case a fingerprint is
stored under each segment with the codeword of each other one, six keys of 33 or 34 bits, and looked up
under the codewords of the other segment and of its one-bit neighbours (at most six). For the second
case the key is the three codewords, 36 bits: stored under the near codewords of the first segment,
looked up under those of the other two. Every pair within three bits meets, and the keys are so long
that others hardly do; the distance itself is then checked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import LIGHT, block_pairs, blocks_of
from millrace.llm.common import components, slices, with_ids
from millrace.session import materialise

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEGMENT_PAIRS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
NEAR = 6
GOLAY_POLYNOMIAL = 0b101011100011
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash64(text: bytes | None) -> int:
    """Fingerprint of a text's word shingles; 0 without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fp BIGINT) per row of ``docs``; a null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([simhash64(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


@lru_cache(1)
def _error_of_syndrome() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of single bits, and the error pattern of each of the 2,048 syndromes."""
    single = []
    for bit in range(23):
        rest = 1 << bit
        for high in range(bit, 10, -1):
            if rest >> high & 1:
                rest ^= GOLAY_POLYNOMIAL << (high - 11)
        single.append(rest)
    errors = np.zeros(2048, dtype=np.int64)
    for i in range(23):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return np.array(single, dtype=np.int64), errors


def codeword(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4,095) of the codeword nearest to each 23-bit word."""
    single, errors = _error_of_syndrome()
    syndrome = np.zeros_like(words)
    for bit in range(23):
        syndrome ^= np.where(words >> bit & 1, single[bit], 0)
    return (words ^ errors[syndrome]) >> 11


def near_codewords(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the codewords of it and of its one-bit neighbours: NEAR columns, and which count.

    A word at distance three from its codeword has neighbours at distance four, which share five others
    at most; a nearer word has one.
    """
    flips = np.array([0, *(1 << bit for bit in range(width))], dtype=np.int64)
    found = np.sort(codeword(words[:, None] ^ flips[None, :]), axis=1)
    fresh = np.ones(found.shape, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    first = np.argsort(~fresh, axis=1, kind="stable")[:, :NEAR]
    return np.take_along_axis(found, first, axis=1), np.take_along_axis(fresh, first, axis=1)


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    words = fps.view(np.uint64)
    return [
        (words >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        for at, width in SEGMENTS
    ]


def golay_keys(fps: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Stored keys and lookup keys of each fingerprint, each as (keys, which count), a row apiece.

    The number of the kind of key stands above its 36 bits.
    """
    raw = _segments(fps)
    own = [codeword(s) for s in raw]
    near = [near_codewords(s, width) for s, (_, width) in zip(raw, SEGMENTS, strict=True)]
    stored, looked, counts = [], [], []
    for kind, (i, j) in enumerate(SEGMENT_PAIRS):
        base = (kind << 36) + (raw[i] << 12)
        stored.append((base + own[j])[:, None])
        looked.append(base[:, None] + near[j][0])
        counts.append(near[j][1])
    three = len(SEGMENT_PAIRS) << 36
    stored.append(three + (near[0][0] << 24) + ((own[1] << 12) + own[2])[:, None])
    pairs = (near[1][0][:, :, None] << 12) + near[2][0][:, None, :]
    looked.append((three + (own[0] << 24))[:, None] + pairs.reshape(len(fps), -1))
    counts.append((near[1][1][:, :, None] & near[2][1][:, None, :]).reshape(len(fps), -1))
    kept = np.concatenate([np.ones((len(fps), len(SEGMENT_PAIRS)), dtype=bool), near[0][1]], axis=1)
    return (np.concatenate(stored, axis=1), kept), (np.concatenate(looked, axis=1), np.concatenate(counts, axis=1))


def keyed(fps: DataFrame) -> DataFrame:
    """Rows (fp, key, stored): the keys under which fingerprints are stored and looked up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            own = batch.column(0).to_numpy()
            for is_stored, (keys, counts) in zip((True, False), golay_keys(own), strict=True):
                flat = keys[counts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, counts.sum(axis=1))), pa.array(flat), pa.array(np.full(len(flat), is_stored))],
                    ["fp", "key", "stored"],
                )

    return fps.select("fp").mapInArrow(run, "fp bigint, key bigint, stored boolean")


def _linked(group: pd.DataFrame) -> pd.DataFrame:
    """Links that connect the members of two blocks as all close pairs between them would."""
    is_left = group["is_left"].to_numpy()
    fps = group["fp"].to_numpy()
    x, y = fps[is_left], fps[~is_left]
    none = np.iinfo(np.int64).max
    close = np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)) <= MAX_BITS
    label = np.where(close.any(axis=1), np.arange(len(x)), none)
    while True:
        below = np.where(close, label[:, None], none).min(axis=0, initial=none)
        after = np.minimum(label, np.where(close, below[None, :], none).min(axis=1, initial=none))
        if (after == label).all():
            break
        label = after
    left, right = label != none, below != none
    return pd.DataFrame(
        {
            "a": np.concatenate([x[left], y[right]]),
            "b": np.concatenate([x[label[left]], x[below[right]]]),
        }
    )


def close_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within three bits.

    ``fps`` holds distinct fingerprints. Their keys are written once, some 11 stored and 61 looked up
    each, whatever follows. Light buckets give their close pairs, heavy ones a spanning forest per pair
    of blocks.
    """
    keys = materialise(keyed(fps), "golay-keys")
    stored, looked = keys.where("stored").select("key", "fp"), keys.where("not stored").select("key", "fp")
    sizes = stored.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    heavy = materialise(sizes.where(F.col("n") > LIGHT), "heavy-buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    light = stored.join(heavy, "key", "left_anti").select("key", F.col("fp").alias("b"))
    links = (
        looked.select("key", F.col("fp").alias("a"))
        .alias("x")
        .join(light.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("a") < F.col("b")) & near)
        .select("a", "b")
    )
    if heavy.isEmpty():
        return links
    lookups = looked.join(heavy.select("key"), "key", "left_semi")
    counts = lookups.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    blocks = heavy.join(counts, "key").select(
        "key", blocks_of(F.col("m")).alias("left_blocks"), blocks_of(F.col("n")).alias("right_blocks")
    )
    blocks = materialise(blocks, "blocks")
    pairs = block_pairs(lookups, stored, ["key"], "fp", blocks)
    forest = pairs.groupBy("key", "block_l", "block_r").applyInPandas(_linked, "a bigint, b bigint")
    return links.unionByName(forest.where("a != b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per row of ``docs``.

    Equal fingerprints are one node, so that any number of copies costs nothing beyond its rows.
    ``component_id`` is the smallest id in the group. Null and empty texts have fingerprint zero
    and link like any other. Rows with a null id get a fingerprint and a component like others;
    a null never is the smallest id, and a group of nulls only has a null component. Repeated
    rows stay. Other columns of ``docs`` are left out. An empty table gives an empty table.
    """
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(close_links(fps)).withColumnRenamed("node", "fp")
    joined = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(joined.join(least, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; all columns stay.

    Of repeated rows with the same id all stay, as they cannot be told apart. Rows with a null id
    stay only if their whole group has none. Null and empty texts are near copies of each other. Columns
    of any name are kept as they are; no rows give no rows.
    """
    groups = near_duplicates(docs, id_col, text_col)
    return with_ids(docs, id_col, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), "left_semi")
