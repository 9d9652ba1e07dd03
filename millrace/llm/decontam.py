"""Benchmark passages in documents, up to edits, by CGK random walks and bit sampling.

Words are the symbols. A CGK walk reads a string from a place on: at each step it puts out the word it
stands on, and a random function of the step and that word tells whether it goes on to the next one. The
outputs of two walks by the same function agree as long as the strings do, stay behind an edit for a few
steps at most and meet again: edits become differing outputs. A key is made of the outputs of the first
steps only, the coordinates of the embedding that edits elsewhere in an item-sized window cannot reach.

Every word of an item is the start of a window and so an anchor of walks, by several functions. An item
that may differ in k words keeps a run of (n - k) / (k + 1) words, rounded up, wherever its edits stand;
anchors store the walk that reads most words of a run so long, and documents are looked up from every
place under all functions. So one edit pattern is as good as another, and the number of functions follows
from the share of anchors that shall have a walk over most of the run. Candidates are then checked by the
exact edit distance of the whole item to the best place in its surroundings.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, with_ids

WORD = re.compile(r"\w+")
SIMILARITY = 0.8
RECALL = 0.99
ITEM_BLOCK = 2048
ITEMS_PER_PASS = 65_536
BITMAP_BITS = 22
SEED = 9
MEMO_ENTRIES = 500_000
LONG_CHUNK = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit number per lower-cased word."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w.lower().encode("utf-8", "replace")) for w in WORD.findall(text)], dtype=np.uint64)


def allowed(words: int, similarity: float = SIMILARITY) -> int:
    """Largest edit distance, in words, of an item of that many words."""
    return int((1 - similarity) * words + 1e-9)


def _extend(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    mixed = (key ^ words) * _ODD
    return mixed ^ (mixed >> np.uint64(32))


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - BITMAP_BITS)).view(np.int64)


def run_length(words: int, limit: int) -> int:
    """Words in a row that ``limit`` edits of an item leave whole at least."""
    return -(-(words - limit) // (limit + 1))


def steps_for(run: int) -> int:
    """Steps of a walk over a run: so many that it reads most of the run and seldom leaves it."""
    return 2 * run - 2 if run > 2 else run


def functions_for(recall: float = RECALL, run: int = 4) -> int:
    """Walk functions, so that an anchor has one that reads all of a run or all but a word."""
    moves = steps_for(run) - 1
    good = sum(math.comb(moves, m) for m in (run - 2, run - 1)) / 2**moves
    return math.ceil(math.log(1 - recall) / math.log(1 - good))


def walk(line: np.ndarray, at: np.ndarray, function: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, places) of the walks that begin at ``at``, after each step."""
    salts = np.random.default_rng((SEED, function)).integers(0, 1 << 63, steps + 1, dtype=np.uint64)
    key, place = np.full(len(at), salts[0]), at
    for step in range(steps):
        word = line[place]
        key = _extend(key, word)
        yield key, place
        mixed = (word ^ salts[step + 1]) * _ODD
        place = place + ((mixed ^ (mixed << np.uint64(21))) >> np.uint64(63)).view(np.int64)


@dataclass
class Keys:
    """Stored walks of one function after one number of steps: by bitmap and by sorted key."""

    function: int
    steps: int
    bitmap: np.ndarray
    keys: np.ndarray
    items: np.ndarray
    offsets: np.ndarray


def build_keys(items: list[np.ndarray], limits: list[int], recall: float) -> list[Keys]:
    """The walks that the anchors of all items store, by function and steps."""
    runs = np.array([min(4, run_length(len(i), k)) for i, k in zip(items, limits, strict=True)], dtype=np.int64)
    sizes = np.array([len(i) for i in items], dtype=np.int64)
    words = np.concatenate([*items, np.zeros(8, dtype=np.uint64)])
    begin = np.cumsum(sizes) - sizes
    out = []
    for run in np.unique(runs).tolist():
        chosen, steps = np.flatnonzero(runs == run), steps_for(run)
        owner = np.repeat(chosen, sizes[chosen])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[chosen]) - sizes[chosen], sizes[chosen])
        at, room = begin[owner] + offset, np.minimum(run, sizes[owner] - offset)
        keys, read = [], []
        for function in range(functions_for(recall)):
            *_, (key, place) = walk(words, at, function, steps)
            keys.append(key)
            read.append(place - at + 1)
        read = np.stack(read)
        read[read > room] = 0
        best = read.argmax(axis=0)
        for function in range(functions_for(recall)):
            mine = np.flatnonzero((best == function) & (read[function] > 0))
            mine = mine[np.argsort(keys[function][mine], kind="stable")]
            if len(mine):
                key = keys[function][mine]
                bitmap = np.zeros(1 << BITMAP_BITS, dtype=bool)
                bitmap[_slot(key)] = True
                out.append(Keys(function, steps, bitmap, key, owner[mine], offset[mine]))
    return sorted(out, key=lambda k: (k.function, k.steps))


def _last_row(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Edit distance of the item to the best stretch that ends before each place of ``words``."""
    ramp = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, dtype=np.int64)
    for number, word in enumerate(item, 1):
        below = np.empty_like(row)
        below[0] = number
        below[1:] = np.minimum(row[1:] + 1, row[:-1] + (words != word))
        row = np.minimum.accumulate(below - ramp) + ramp
    return row


def best_place(item: np.ndarray, words: np.ndarray, guess: int, limit: int) -> tuple[int, int, int] | None:
    """(distance, first, end) of the stretch of ``words`` nearest to the item, None over the limit.

    ``guess`` is where it may stand unchanged.
    """
    if guess >= 0 and np.array_equal(words[guess : guess + len(item)], item):
        return 0, guess, guess + len(item)
    row = _last_row(item, words)
    end = int(row.argmin())
    if row[end] > limit:
        return None
    back = _last_row(item[::-1], words[:end][::-1])
    exact = np.flatnonzero(back == row[end])
    return int(row[end]), end - int(exact[np.abs(exact - len(item)).argmin()]), end


class Finder:
    """Finds the items of one block in documents given as word hashes."""

    def __init__(self, items: list[np.ndarray], similarity: float, recall: float = RECALL):
        self.items, self.limits = items, [allowed(len(i), similarity) for i in items]
        self.keys = build_keys(items, self.limits, recall)
        self.gap = 2 + max((len(i) + k for i, k in zip(items, self.limits, strict=True)), default=0)

    def _line(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words in one array with gaps that no item has; where texts begin; word places."""
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        begin = self.gap + np.concatenate([[0], np.cumsum(sizes + self.gap)[:-1]]).astype(np.int64)
        line = np.arange(int(begin[-1] + sizes[-1]) + self.gap + 8, dtype=np.uint64) * _ODD
        real = np.zeros(len(line), dtype=bool)
        for at, words in zip(begin, docs, strict=True):
            line[at : at + len(words)] = words
            real[at : at + len(words)] = True
        return line, begin, np.flatnonzero(real)

    def _candidates(self, line: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (item, place of its first word on the line) where a stored walk is met."""
        pairs = [np.empty(0, dtype=np.int64)]
        for function in range(max((k.function for k in self.keys), default=-1) + 1):
            stored = {k.steps: k for k in self.keys if k.function == function}
            for number, (key, _) in enumerate(walk(line, places, function, max(stored, default=0)), 1):
                if number not in stored:
                    continue
                entry = stored[number]
                met = np.flatnonzero(entry.bitmap[_slot(key)])
                at, key = places[met], key[met]
                first = np.searchsorted(entry.keys, key, "left")
                count = np.searchsorted(entry.keys, key, "right") - first
                each = np.repeat(np.arange(len(at)), count)
                which = np.repeat(first, count) + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                pairs.append(entry.items[which] * len(line) + at[each] - entry.offsets[which])
        distinct = np.unique(np.concatenate(pairs))
        return distinct // len(line), distinct % len(line)

    def _plausible(self, number: int, starts: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Starts with enough of the item's words around: fewer cannot be within the limit."""
        item, limit = self.items[number], self.limits[number]
        shift = np.uint64(48)
        there = np.zeros(1 << 16, dtype=bool)
        there[((item * _ODD) >> shift).view(np.int64)] = True
        around = np.arange(-limit, len(item) + limit)
        kept = [np.empty(0, dtype=np.int64)]
        for at in range(0, len(starts), 512):
            part = starts[at : at + 512]
            window = line[np.clip(part[:, None] + around[None, :], 0, len(line) - 1)]
            shared = there[((window * _ODD) >> shift).view(np.int64)].sum(axis=1) >= len(item) - limit
            part, window = part[shared], window[shared]
            both = np.zeros(len(part), dtype=np.int64)
            for word in item:
                both += (window == word).any(axis=1)
            kept.append(part[both >= len(item) - limit])
        return np.concatenate(kept)

    def find(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """Checked hits (document, item, distance, first word, end word), the nearest per pair."""
        if not self.keys or not docs:
            return []
        line, begin, places = self._line(docs)
        if not len(places):
            return []
        items, starts = self._candidates(line, places)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        seen: dict[tuple[int, int], int] = {}
        for number in np.unique(items).tolist():
            item, limit = self.items[number], self.limits[number]
            likely = self._plausible(number, starts[items == number], line)
            owners = np.searchsorted(begin, likely + limit, "right") - 1
            for start, doc in zip(likely.tolist(), owners.tolist(), strict=True):
                if doc < 0:
                    continue
                pair, words, own = (doc, number), docs[doc], start - int(begin[doc])
                low, high = max(0, own - limit), min(len(words), own + len(item) + limit)
                if high <= seen.get(pair, -1) or high - low < len(item) - limit or best.get(pair, (1,))[0] == 0:
                    continue
                hit = best_place(item, words[low:high], own - low, limit)
                if hit:
                    seen[pair] = high
                    if pair not in best or hit[0] < best[pair][0]:
                        best[pair] = (hit[0], low + hit[1], low + hit[2])
        return [(doc, item, *hit) for (doc, item), hit in sorted(best.items())]


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[list[tuple]]:
    held = []
    for row in items.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        words = word_hashes(row[1] or "")
        if len(words):
            held.append((row[0], words))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = SIMILARITY,
    item_block: int = ITEM_BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, item_id, distance, similarity, start, end): a document's nearest place to an item.

    ``distance`` counts edited words of the whole item, at most (1 - similarity) of its words, and a pair
    within that limit is found with at least RECALL;
    ``start`` and ``end`` are character offsets. A task searches its documents for the items in blocks of
    ``item_block``; a pass over the documents takes ITEMS_PER_PASS items, some 30 MB of word hashes. Null and empty texts and items without words match nothing.
    Items of fewer than five words must be equal. Null ids stay null, repeated documents give a row
    each, equal items a row each. Other columns are left out. Empty tables give an empty table.
    """
    schema = "doc_id bigint, item_id bigint, distance int, similarity double, start bigint, end bigint"
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out, blocks = None, _item_blocks(items, item_id_col, item_text_col, item_block)
    while held := list(itertools.islice(blocks, -(-ITEMS_PER_PASS // item_block))):
        found = rows.mapInArrow(_finder_task([spark.sparkContext.broadcast(b) for b in held], similarity), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _finder_task(blocks: list, similarity: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [b[0] for block in blocks for b in block.value]
        words = [b[1] for block in blocks for b in block.value]
        finders, first_item = [], []
        for block in blocks:
            first_item.append(sum(len(f.items) for f in finders))
            finders.append(Finder([b[1] for b in block.value], similarity))
        memo: dict[str, bytes] = {}
        for batch in slices(batches):
            texts, docs, new = batch.column(1).to_pylist(), [], []
            for text in texts:
                chunks = (text or "").split()
                fresh = {c for c in chunks if c not in memo}
                for chunk in fresh:
                    memo[chunk] = word_hashes(chunk).tobytes()
                docs.append(np.frombuffer(b"".join(map(memo.__getitem__, chunks)), dtype=np.uint64))
                new += fresh
            full = len(memo) > MEMO_ENTRIES
            for chunk in new:
                if full or len(chunk) > LONG_CHUNK:
                    memo.pop(chunk, None)
            hits = sorted(
                (doc, first + item, *place)
                for finder, first in zip(finders, first_item, strict=True)
                for doc, item, *place in finder.find(docs)
            )
            keys = batch.column(0).to_pylist()
            spans: dict[int, list] = {}
            columns: list[list] = [[] for _ in range(6)]
            for doc, item, distance, first, end in hits:
                if doc not in spans:
                    spans[doc] = [m.span() for m in WORD.finditer(texts[doc])]
                size = len(words[item])
                values = (keys[doc], ids[item], distance, 1 - distance / size)
                for column, value in zip(columns, (*values, spans[doc][first][0], spans[doc][end - 1][1]), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "item_id", "distance", "similarity", "start", "end"],
            )

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns; equal ids go together.

    A null id goes if any row with a null id holds an item; null and empty texts hold none. Columns of
    any name are kept as they are. No items keep all rows; no rows give no rows.
    """
    return with_ids(docs, id_col, contaminated(docs, items, id_col=id_col, text_col=text_col), "left_anti")
