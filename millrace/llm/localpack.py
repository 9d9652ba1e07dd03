"""Packing of token pieces into sequences by swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices
from millrace.llm.tokens import encoder, tokenizer_path
from millrace.session import materialise

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 32_768
PATIENCE = 64


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece, longest first, each into the fullest bin that still holds it."""
    bins = np.empty(len(lengths), dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_room = 0  # bit r is set if a bin with r free places waits
    number = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        above = open_room >> need
        if need and above:
            room = need + (above & -above).bit_length() - 1
            chosen = waiting[room].pop()
            if not waiting[room]:
                open_room ^= 1 << room
        else:
            room, chosen = capacity, number
            number += 1
        bins[item] = chosen
        if room > need:
            if not waiting[room - need]:
                open_room |= 1 << (room - need)
            waiting[room - need].append(chosen)
    return bins


def fewest_bins(lengths: np.ndarray, capacity: int) -> int:
    """Lower bound: for each t, pieces over capacity - t stand alone, those of t or more share."""
    count = np.bincount(lengths, minlength=capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    for t in range(1, half + 1):
        alone = int(number[-1] - number[capacity - t])
        large = int(number[capacity - t] - number[half])
        large_sum = int(total[capacity - t] - total[half])
        small_sum = int(total[half] - total[t - 1])
        over = small_sum - (large * capacity - large_sum)
        best = max(best, alone + large + max(0, -(-over // capacity)))
    return best


class LocalSearch:
    """Empty bins by exchanges that each raise the sum of squared fills.

    The emptiest bin gives a piece away (move), or gets a shorter one for it (one for one), or two
    that together are shorter (two for one). It stays the emptiest, so every step raises the sum.
    """

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int):
        self.size, self.bin, self.capacity = lengths, bins.copy(), capacity
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        self.room = capacity - fill

    def _put(self, item: int, target: int) -> None:
        self.room[self.bin[item]] += self.size[item]
        self.room[target] -= self.size[item]
        self.bin[item] = target

    def _move(self, item: int, donor: int) -> bool:
        room = np.where(self.room >= self.size[item], self.room, self.capacity + 1)
        room[donor] = self.capacity + 1
        room[self.closed] = self.capacity + 1
        target = int(room.argmin())
        if room[target] > self.capacity:
            return False
        self._put(item, target)
        return True

    def _one(self, item: int, donor: int) -> bool:
        gain = self.size[item] - self.size
        gain[(self.room[self.bin] < gain) | (self.bin == donor)] = 0
        other = int(gain.argmax())
        if gain[other] <= 0:
            return False
        target = int(self.bin[other])
        self._put(other, donor)
        self._put(item, target)
        return True

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.bin, kind="stable")
        home = self.bin[order]
        first, second, lag = [], [], 1
        while lag < len(order):
            same = np.flatnonzero(home[lag:] == home[:-lag])
            if not len(same):
                break
            first.append(order[same])
            second.append(order[same + lag])
            lag += 1
        none = np.empty(0, dtype=np.int64)
        return np.concatenate([none, *first]), np.concatenate([none, *second])

    def _two(self, item: int, donor: int) -> bool:
        first, second = self._pairs()
        gain = self.size[item] - self.size[first] - self.size[second]
        home = self.bin[first]
        gain[(self.room[home] < gain) | (home == donor)] = 0
        if not len(gain) or gain.max() <= 0:
            return False
        best = int(gain.argmax())
        target = int(home[best])
        self._put(int(first[best]), donor)
        self._put(int(second[best]), donor)
        self._put(item, target)
        return True

    def _improve(self, donor: int) -> bool:
        items = np.flatnonzero(self.bin == donor)
        items = items[np.argsort(-self.size[items], kind="stable")].tolist()
        for step in (self._move, self._one, self._two):
            if any(step(item, donor) for item in items):
                return True
        return False

    def run(self) -> np.ndarray:
        """Try bins, emptiest first, until the lower bound, or PATIENCE of them in a row stay."""
        self.closed = np.zeros(len(self.room), dtype=bool)
        stuck = np.zeros(len(self.room), dtype=bool)
        used, bound = len(self.room), fewest_bins(self.size, self.capacity)
        while used > bound:
            fill = np.where(self.closed | stuck, self.capacity, self.capacity - self.room)
            donor = int(fill.argmin())
            if fill[donor] >= self.capacity or stuck.sum() >= PATIENCE:
                break
            if not self._improve(donor):
                stuck[donor] = True
            elif self.room[donor] == self.capacity:
                self.closed[donor] = True
                used -= 1
                stuck[:] = False
        return self.bin


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each piece. Lengths lie between 1 and the capacity."""
    lengths = np.asarray(lengths, dtype=np.int64)
    if not len(lengths):
        return lengths
    return LocalSearch(lengths, best_fit(lengths, capacity), capacity).run()


def token_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut only
    where they exceed the capacity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file).encode
        end = np.array([end_id], dtype="<u4")
        for batch in slices(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            ids = batch.column(0).to_pylist()
            for key, found in zip(ids, encode(batch.column(1).to_pylist()), strict=True):
                tokens = np.concatenate([found, end])
                for number, at in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[at : at + capacity]
                    doc.append(key)
                    piece.append(number)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(run, schema)


def _place(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values(["length", "row"], ascending=[False, True], kind="stable")
    bins = pack(group["length"].to_numpy(), capacity)
    group = group.assign(bin=bins)
    offset = group.groupby("bin")["length"].cumsum() - group["length"]
    sequence = group["group"].astype("int64") * (1 << 32) + bins
    return group.drop(columns=["row", "group", "bin"]).assign(sequence_id=sequence, offset=offset)


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Place every document's pieces into sequences of at most ``capacity`` tokens.

    Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset). Full pieces are sequences
    of their own. The others are dealt at random into groups of about ``group_pieces``, each packed
    by local search in one task; a group wastes about one sequence, so the whole stays within one
    in some ten thousand of its bound. Null and empty texts have the end id only. Null ids stay
    null, repeated rows are packed each, other columns are left out, no rows give no rows.
    """
    pieces = token_pieces(docs, tokenizer_file or tokenizer_path(), capacity, end_id, id_col, text_col)
    pieces = materialise(pieces, "pieces").withColumn("row", F.monotonically_increasing_id())
    partial = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-partial.count() // group_pieces))
    grouped = partial.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    schema = (
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint"
    )
    packed = grouped.groupBy("group").applyInPandas(lambda g: _place(g, capacity), schema)
    full = pieces.where(F.col("length") >= capacity)
    alone = full.withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("bigint")}).drop("row")
    return packed.unionByName(alone)
