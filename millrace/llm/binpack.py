"""Token-id output: documents packed best-fit-decreasing into id matrices.

A partition packs what it has read, in blocks of bounded size, so ids are never shuffled and a
lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices
from millrace.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
PAD_ID = 0
BLOCK_TOKENS = 3_000_000
SCHEMA = (
    "sequence_id bigint, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, "
    "doc_ids array<bigint>, starts array<bigint>"
)


class CapacityTree:
    """Segment tree over the free places 0..capacity that counts the open bins at each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += change
            node >>= 1

    def smallest(self, need: int) -> int:
        """The smallest room of at least ``need`` that some bin has, or -1."""
        count, node = self.count, self.leaves + need
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: longest first, each into the fullest bin that holds it."""
    tree, waiting, bins = CapacityTree(capacity), {}, []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[item]
        room = tree.smallest(need)
        if room < 0:
            room, chosen = capacity, len(bins)
            bins.append([])
        else:
            chosen = waiting[room].pop()
            tree.add(room, -1)
        bins[chosen].append(item)
        if room > need:
            waiting.setdefault(room - need, []).append(chosen)
            tree.add(room - need, 1)
    return bins


def _matrix(pieces: list[tuple], first: int, capacity: int, pad_id: int) -> pa.RecordBatch:
    """One packed block; ``pieces`` are (doc_id, start, ids)."""
    bins = best_fit_decreasing([len(p[2]) for p in pieces], capacity)
    ids = np.full((len(bins), capacity), pad_id, dtype="<u4")
    positions = np.zeros((len(bins), capacity), dtype="<u4")
    ends, docs, starts = [], [], []
    for row, items in enumerate(bins):
        at, cuts = 0, [0]
        for item in items:
            part = pieces[item][2]
            ids[row, at : at + len(part)] = part
            positions[row, at : at + len(part)] = np.arange(len(part))
            at += len(part)
            cuts.append(at)
        ends.append(cuts)
        docs.append([pieces[item][0] for item in items])
        starts.append([pieces[item][1] for item in items])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(first, first + len(bins)), pa.int64()),
            pa.array([cuts[-1] for cuts in ends], pa.int32()),
            pa.array([row.tobytes() for row in ids], pa.binary()),
            pa.array([row.tobytes() for row in positions], pa.binary()),
            pa.array(ends, pa.list_(pa.int32())),
            pa.array(docs, pa.list_(pa.int64())),
            pa.array(starts, pa.list_(pa.int64())),
        ],
        ["sequence_id", "n_tokens", "ids", "position_ids", "cu_seqlens", "doc_ids", "starts"],
    )


def packed_rows(
    docs: DataFrame,
    tokenizer_file: str | None = None,
    capacity: int = CAPACITY,
    pad_id: int = PAD_ID,
    end_id: int = 0,
    block_tokens: int = BLOCK_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per sequence of ``capacity`` ids.

    ``ids`` and ``position_ids`` are matrix rows of little-endian unsigned 32-bit numbers, filled
    with ``pad_id`` and 0 after ``n_tokens``; ``cu_seqlens`` starts with 0 and ends with
    ``n_tokens``; positions restart at every segment. ``doc_ids`` and ``starts`` say which ids of
    which document a segment holds: longer documents are cut, and nothing is lost. Null and empty
    texts give the end id only; null ids stay null; repeated rows are packed each; other columns
    are left out; no rows give no rows.
    """
    from pyspark import TaskContext

    path = tokenizer_file or tokenizer_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([end_id], dtype="<u4")
        first, held, pieces = TaskContext.get().partitionId() << 40, 0, []
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            for key, found in zip(ids, encode(batch.column(1).to_pylist()), strict=True):
                tokens = np.concatenate([found, end])
                for at in range(0, len(tokens), capacity):
                    pieces.append((key, at, tokens[at : at + capacity]))
                held += len(tokens)
                if held >= block_tokens:
                    block = _matrix(pieces, first, capacity, pad_id)
                    first, held, pieces = first + block.num_rows, 0, []
                    yield from slices([block], 512)
        if pieces:
            yield from slices([_matrix(pieces, first, capacity, pad_id)], 512)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrices, lengths and positions as Parquet, one file per task."""
    packed.write.parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """Rows (doc_id, start, ids array<bigint>) of all segments: the round trip of a packed table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, start, ids = [], [], []
            for row in batch.to_pylist():
                matrix = np.frombuffer(row["ids"], dtype="<u4")
                cuts = row["cu_seqlens"]
                for i, key in enumerate(row["doc_ids"]):
                    doc.append(key)
                    start.append(row["starts"][i])
                    ids.append(matrix[cuts[i] : cuts[i + 1]].astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.list_(pa.int64()))],
                ["doc_id", "start", "ids"],
            )

    return packed.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(
        run, "doc_id bigint, start bigint, ids array<bigint>"
    )
