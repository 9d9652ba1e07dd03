"""Byte-pair vocabularies: word counts, training, and encoding inside the row.

Training works on the table of distinct words.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.indexing import by_key
from millrace.session import discard, exists, materialise

# Special tokens and their ids, whatever a caller asks for.
SPECIALS = ["[UNK]", "[PAD]", "[EOS]"]
UNK, PAD, EOS = 0, 1, 2
META = "▁"
# Fixed value: the public byte-level pre-token pattern.
BYTE_LEVEL = (
    r"(?U)('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"
)
# The same for ASCII, where blanks are U+0009 to U+000D and U+0020.
ASCII_BYTE_LEVEL = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
# A symbol is written as one character, so that a merge is a plain string replacement and the
# binary order of symbols is the order of their ids. Planes above the basic one hold a million.
SYMBOL_BASE = 0x10000
SYMBOL_BYTES = 4
SYMBOL_ROOM = 2**19
# Hot pairs that a round begins with and may grow to, and symbols of runs that the driver may hold.
HOT_PAIRS = 16
MAX_HOT_PAIRS = 2**16
RUN_SYMBOLS = 8_000_000
RUNS_PER_FLUSH = 200_000
# Symbols of a word beyond which its merges are queued instead of sought in sweeps.
SWEPT_SYMBOLS = 256
NEVER = np.iinfo(np.int32).max
MEMO_WORDS = 500_000
ENCODED_ROWS = 256
SHARED_VOCABULARIES = 16
SEPARATOR = chr(0x10FFFF)


def byte_alphabet() -> list[str]:
    """Printable character of each byte: Latin-1's printable ones stand for themselves and the
    others follow from U+0100 on."""
    spare = iter(range(256, 512))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_BYTES = "".join(chr(b) for b in range(256))
_PRINTABLE = "".join(byte_alphabet())


def to_byte_symbols(text: Column) -> Column:
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _BYTES, _PRINTABLE)


def byte_symbols(text: str) -> str:
    """``to_byte_symbols`` inside a task."""
    return "".join(_PRINTABLE[b] for b in text.encode())


def from_byte_symbols(text: Column) -> Column:
    raw = F.encode(F.translate(text, _PRINTABLE, _BYTES), "ISO-8859-1")
    return F.make_valid_utf8(raw.cast("string"))


def metaspace_parts(text: Column) -> Column:
    """Words without the blank's sign that they begin with; only U+0020 separates."""
    # A plain split, as a pattern for whole words takes far longer.
    spaced = F.replace(text, F.lit(META), F.lit(" "))
    parts = F.split(spaced, " ")
    parts = F.when(F.startswith(spaced, F.lit(" ")), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    return F.when(text != "", parts).otherwise(F.array().cast("array<string>"))


def metaspace_words(text: Column) -> Column:
    """Words that begin with the blank's sign."""
    return F.transform(metaspace_parts(text), lambda w: F.concat(F.lit(META), w))


def byte_level_words(text: Column) -> Column:
    led = F.when(F.startswith(text, F.lit(" ")), text).otherwise(F.concat(F.lit(" "), text))
    return F.when(
        text != "", F.regexp_extract_all(led, F.lit(BYTE_LEVEL), F.lit(1))
    ).otherwise(F.array().cast("array<string>"))


def ascii_byte_level_words(text: str) -> list[str]:
    """``byte_level_words`` of an ASCII text inside a task."""
    return ASCII_BYTE_LEVEL.findall(text if text.startswith(" ") else f" {text}") if text else []


def word_counts(words: DataFrame, column: str = "words") -> DataFrame:
    """Occurrences of each distinct word, counted per partition before the shuffle.

    ``explode_outer``, as ``explode`` of a computed column would have the optimizer compute it a
    second time to filter empty arrays.
    """
    return (
        words.select(F.explode_outer(column).alias("word"))
        .where(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def shard_word_counts(words: DataFrame, column: str = "words") -> DataFrame:
    """Occurrences of each word in each shard, from (shard_id, words)."""
    return (
        words.select("shard_id", F.explode_outer(column).alias("word"))
        .where(F.col("word").isNotNull())
        .groupBy("shard_id", "word")
        .agg(F.count("*").alias("n"))
    )


def store_shard_counts(corpus: DataFrame, words_of: Callable[..., DataFrame], path: str) -> None:
    """Add the count tables of shards of (shard_id, content) that the store does not have yet; none is counted twice.

    Texts are shuffled once, by shard, and a shard's words (``words_of``) are counted where they are split.

    A shard's table is a folder of its own and appears with the commit of the job that wrote it, so a
    lost or repeated job neither loses nor repeats a shard. A shard without words has no folder and is
    counted again, to nothing.
    """
    spark, texts = corpus.sparkSession, corpus.select("shard_id", "content")
    if exists(spark, path):
        texts = texts.join(spark.read.parquet(path).select("shard_id").distinct(), "shard_id", "left_anti")
    words = words_of(by_key(texts, "shard_id"), "shard_id")
    shard_word_counts(words).write.mode("append").partitionBy("shard_id").parquet(path)


def merged_counts(spark: SparkSession, path: str, train_shards: int | None = None) -> DataFrame:
    """Word counts (word, n) of the first ``train_shards`` shards of a store, all without it.

    Counts are sums, so no text is read again, whichever shards are chosen.
    """
    stored = spark.read.schema("word string, n bigint, shard_id int").parquet(path)
    if train_shards is not None:
        stored = stored.where(F.col("shard_id") < train_shards)
    return stored.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id, and merges (left id, right id, merged id) by rank.

    Its size is the trained one, at most SYMBOL_ROOM, so it may travel with a task.
    """

    tokens: list[str]
    merges: list[tuple[int, int, int]]

    def __len__(self) -> int:
        return len(self.tokens)

    def first(self, merges: int) -> Vocabulary:
        """The vocabulary that training would have reached after so many merges."""
        kept = self.merges[:merges]
        size = len(SPECIALS) + sum(len(t) == 1 for t in self.tokens[len(SPECIALS) :])
        return Vocabulary(self.tokens[: max([size, *(m + 1 for _, _, m in kept)])], kept)

    def id_of(self, token: str) -> int | None:
        return self.tokens.index(token) if token in self.tokens else None

    def token_at(self, token_id: Column) -> Column:
        """Token text by id; the list is folded into one constant array."""
        listed = F.split(F.lit(SEPARATOR.join(self.tokens)), F.lit(SEPARATOR))
        return F.get(listed, token_id.cast("int"))

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        merged = {m for _, _, m in self.merges}

        def kind(i: int) -> str:
            return "special" if i < len(SPECIALS) else "merge" if i in merged else "alphabet"

        rows = [(t, i, kind(i)) for i, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, "token string, id int, kind string")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (r, self.tokens[a], self.tokens[b], self.tokens[m], a, b, m)
            for r, (a, b, m) in enumerate(self.merges)
        ]
        return spark.createDataFrame(
            rows,
            "rank int, left string, right string, merged string, "
            "left_id int, right_id int, merged_id int",
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.vocab_table(spark).write.parquet(f"{path}/vocab")
        self.merge_table(spark).write.parquet(f"{path}/merges")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Vocabulary:
        vocab = spark.read.parquet(f"{path}/vocab").orderBy("id").collect()
        merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
        return Vocabulary(
            [r["token"] for r in vocab],
            [(r["left_id"], r["right_id"], r["merged_id"]) for r in merges],
        )


def symbol(i: int) -> str:
    return chr(SYMBOL_BASE + i)


def ids_of(symbols: str) -> list[int]:
    return [ord(c) - SYMBOL_BASE for c in symbols]


def alphabet_of(counts: DataFrame) -> list[str]:
    """Distinct characters in code point order. Training text holds at most the byte alphabet
    or ASCII; a larger set is refused when it does not fit the symbols."""
    letters = counts.select(F.explode(F.split("word", "")).alias("c")).distinct()
    rows = letters.orderBy("c").limit(SYMBOL_ROOM + 1).collect()
    if len(rows) > SYMBOL_ROOM:
        raise ValueError("more distinct characters than symbols")
    return [r["c"] for r in rows]


def pair_counts(words: DataFrame) -> DataFrame:
    """Weighted occurrences of neighbouring symbols of (symbols, n).

    A symbol takes four bytes, so a pair is an eight-byte slice at a known place, and the whole
    step up to the partial sums is one generated loop.
    """
    raw = F.col("symbols").cast("binary")
    last = (F.octet_length("symbols") / SYMBOL_BYTES).cast("int") - 2
    return (
        words.select(raw.alias("raw"), "n", F.explode(F.sequence(F.lit(0), last)).alias("i"))
        .groupBy(F.substring("raw", F.col("i") * SYMBOL_BYTES + 1, F.lit(2 * SYMBOL_BYTES)).alias("pair"))
        .agg(F.sum("n").alias("n"))
    )


def leading_pairs(counts: DataFrame, most: int) -> list[tuple[int, tuple[int, int]]]:
    """The first pairs of (pair, n) as (-count, ids).

    Read as Arrow, as ``collect`` of a limit sends so many rows of every partition to the driver.
    """
    best = counts.orderBy(F.desc("n"), "pair").limit(most).toArrow()
    pairs = zip(best["n"].to_pylist(), best["pair"].to_pylist(), strict=True)
    return [(-n, tuple(ids_of(pair.decode()))) for n, pair in pairs]


def raw_symbol(i: int) -> int:
    """A symbol's four bytes as a number."""
    return int.from_bytes(symbol(i).encode(), "big")


def raw_symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of the words as numbers, and how many each word has."""
    words = words.cast(pa.string())
    if not len(words):
        return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
    _, places, data = words.buffers()
    ends = np.frombuffer(places, dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    held = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return held.view(">u4").astype(np.uint32), np.diff(ends).astype(np.int64) // SYMBOL_BYTES


def from_raw(symbols: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Words of so many symbols each, which stand one after another."""
    ends = np.concatenate([[0], np.cumsum(sizes * SYMBOL_BYTES)]).astype(np.int32)
    held = symbols.astype(">u4").tobytes()
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(held))


def raw_pairs(pairs: Iterable[tuple[int, int]]) -> np.ndarray:
    """Pairs as numbers of eight bytes."""
    return np.array([raw_symbol(x) << 32 | raw_symbol(y) for x, y in pairs], dtype=np.uint64)


def neighbours(symbols: np.ndarray) -> np.ndarray:
    """The pair that begins at each symbol but the last."""
    wide = symbols.astype(np.uint64)
    return wide[:-1] << np.uint64(32) | wide[1:]


def hot_runs(words: DataFrame, hot: set[str]) -> DataFrame:
    """Longest runs of symbols all of whose neighbours are hot pairs, with their occurrences."""
    shared = words.sparkSession.sparkContext.broadcast(np.sort(raw_pairs(map(ids_of, hot))))

    def runs(batch: pa.RecordBatch, pairs: np.ndarray) -> pa.Table:
        symbols, sizes = raw_symbols(batch.column(0))
        linked = np.zeros(len(symbols) + 1, dtype=bool)
        if len(symbols) > 1:
            codes = neighbours(symbols)
            linked[:-2] = pairs[np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)] == codes
            linked[np.cumsum(sizes) - 1] = False
        follows = np.concatenate([[False], linked[:-1]])
        begins, ends = np.flatnonzero(linked & ~follows), np.flatnonzero(follows & ~linked)
        found = from_raw(symbols[(linked | follows)[:-1]], ends - begins + 1)
        numbers = np.repeat(batch.column(1).to_numpy(), sizes)[begins]
        return pa.table({"run": found, "n": numbers}).group_by("run").aggregate([("n", "sum")])

    def merged(parts: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables([t.select(["run", "n_sum"]).rename_columns(["run", "n"]) for t in parts])
        return whole.group_by("run").aggregate([("n", "sum")])

    def rows(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        yield from merged(parts).select(["run", "n_sum"]).rename_columns(["run", "n"]).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                held.append(runs(batch, shared.value))
            if sum(t.num_rows for t in held) >= RUNS_PER_FLUSH:
                held = [merged(held)]
                if held[0].num_rows * 2 >= RUNS_PER_FLUSH:
                    yield from rows(held)
                    held = []
        if held:
            yield from rows(held)

    found = words.select("symbols", "n").mapInArrow(run, "run string, n bigint")
    return found.groupBy("run").agg(F.sum("n").alias("n"))


class RunTable:
    """Distinct runs of symbols on the driver as flat arrays, with the places of every pair.

    A run's symbols stand in order and are linked to their neighbours; a merge rewrites all places of
    its pair at once. Places of pairs that have changed meanwhile are left in the lists and dropped when
    they are read.
    """

    def __init__(self, runs: pa.ChunkedArray, numbers: np.ndarray):
        symbols = "".join(runs.to_pylist()).encode("utf-32-le")
        self.at = np.frombuffer(symbols, dtype="<u4").astype(np.int32) - np.int32(SYMBOL_BASE)
        sizes = pc.utf8_length(runs).to_numpy().astype(np.int64)
        self.weight = np.repeat(numbers, sizes)
        places = np.arange(len(self.at), dtype=np.int32)
        ends = np.cumsum(sizes) - 1
        self.after, self.before = places + np.int32(1), places - np.int32(1)
        self.after[ends], self.before[ends - sizes + 1] = -1, -1
        self.live = np.ones(len(self.at), dtype=bool)
        self.count: dict[tuple[int, int], int] = defaultdict(int)
        self.where: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        self._add(places[self.after >= 0])

    def _pairs(self, left: np.ndarray, right: np.ndarray, places: np.ndarray) -> Iterator[tuple]:
        """Each distinct pair with its places."""
        codes = left.astype(np.int64) << 32 | right
        order = np.argsort(codes, kind="stable")
        codes, places = codes[order], places[order]
        cuts = np.flatnonzero(np.diff(codes, prepend=-1))
        for code, found in zip(codes[cuts].tolist(), np.split(places, cuts[1:]), strict=True):
            yield (code >> 32, code & 0xFFFFFFFF), found

    def _add(self, places: np.ndarray) -> set[tuple[int, int]]:
        """Count the pairs that begin at these places and remember where they are."""
        risen = set()
        if len(places):
            for pair, found in self._pairs(self.at[places], self.at[self.after[places]], places):
                self.count[pair] += int(self.weight[found].sum())
                self.where[pair].append(found)
                risen.add(pair)
        return risen

    def _remove(self, left: np.ndarray, right: np.ndarray, places: np.ndarray) -> None:
        if len(places):
            for pair, found in self._pairs(left, right, places):
                self.count[pair] -= int(self.weight[found].sum())

    def merge(self, left: int, right: int, merged: int) -> set[tuple[int, int]]:
        """Replace a pair from the left in every run; the pairs with the new symbol."""
        places = np.unique(np.concatenate(self.where.pop((left, right))))
        ends = self.after[places]
        real = self.live[places] & (self.at[places] == left) & (ends >= 0)
        real &= self.at[ends] == right
        places, ends = places[real], ends[real]
        if left == right:
            # In a chain of places that touch each other every second one is taken.
            head = np.ones(len(places), dtype=bool)
            head[1:] = places[1:] != ends[:-1]
            numbers = np.arange(len(places))
            odd = (numbers - np.maximum.accumulate(np.where(head, numbers, 0))) % 2
            places, ends = places[odd == 0], ends[odd == 0]
        lefts, rights = self.before[places], self.after[ends]
        has_right = rights >= 0
        # The pair between two places that touch is the right one of the first.
        taken = np.zeros(len(self.at), dtype=bool) if len(places) * 16 > len(self.at) else None
        if taken is not None:
            taken[ends] = True
            free = (lefts >= 0) & ~taken[lefts]
        else:
            free = (lefts >= 0) & ~np.isin(lefts, ends)
        self.count[left, right] -= int(self.weight[places].sum())
        self._remove(self.at[ends[has_right]], self.at[rights[has_right]], ends[has_right])
        self._remove(self.at[lefts[free]], self.at[places[free]], places[free])
        self.at[places], self.after[places], self.live[ends] = merged, rights, False
        self.before[rights[has_right]] = places[has_right]
        return self._add(places[has_right]) | self._add(lefts[free])


def merges_before(
    table: RunTable,
    bound: tuple[int, tuple[int, int]],
    tokens: list[str],
    known: dict[str, int],
    vocab_size: int,
) -> list[tuple[int, int, int]]:
    """One-at-a-time training while the leading pair ranks before ``bound``, as (-count, ids).

    ``table`` holds the runs of all pairs before the bound. Between two symbols whose pair is not before
    it no pair ever gets there: a token that is new has one spelling in older tokens, so a new pair
    occurs no more often than the two old symbols that meet in it, and its ids are no smaller. All
    other pairs stand inside the runs, with all their occurrences. A merge that spells a token
    already known breaks the argument, so it is the last one. New tokens are added to ``tokens``
    and ``known``.
    """
    count = table.count
    waiting = [(-n, pair) for pair, n in count.items() if (-n, pair) < bound]
    heapq.heapify(waiting)
    merges = []
    while waiting and len(tokens) < vocab_size:
        promised, pair = heapq.heappop(waiting)
        if count[pair] != -promised:
            if count[pair] < -promised and (-count[pair], pair) < bound:
                heapq.heappush(waiting, (-count[pair], pair))
            continue
        text = tokens[pair[0]] + tokens[pair[1]]
        again = text in known
        if not again:
            known[text] = len(tokens)
            tokens.append(text)
        merges.append((*pair, known[text]))
        if again:
            break
        for new in table.merge(*merges[-1]):
            if (-count[new], new) < bound:
                heapq.heappush(waiting, (-count[new], new))
    return merges


def replayed(word: list[int], rules: dict[tuple[int, int], list[tuple[int, int]]]) -> list[int]:
    """One word after merges in their order, each applied once, from the left.

    ``rules`` holds each pair's (time, merged id) in order. A pair is merged at the first time after both
    its symbols came up: a token that is spelled anew does not go back to an earlier merge.
    """
    n = len(word)
    word, born = list(word), [-1] * n
    following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and following[i] < n:
            j = following[i]
            since = max(born[i], born[j])
            for time, merged in rules.get((word[i], word[j]), ()):
                if time > since:
                    heapq.heappush(waiting, (time, i, word[i], word[j], merged))
                    break

    for i in range(n - 1):
        offer(i)
    while waiting:
        time, i, left, right, merged = heapq.heappop(waiting)
        j = following[i]
        if word[i] != left or j >= n or word[j] != right or max(born[i], born[j]) >= time:
            continue
        word[i], born[i], word[j] = merged, time, -1
        following[i] = following[j]
        if following[j] < n:
            preceding[following[j]] = i
        offer(preceding[i])
        offer(i)
    return [t for t in word if t >= 0]


class Sweeps:
    """Merges of a round for many words at once; no pair comes twice in them.

    A sweep takes in every word the places of its earliest merge and replaces them from the left, which
    is what merging in order does (``replayed``). Pairs with the new symbol are merged later or not at all.
    """

    def __init__(self, merges: list[tuple[int, int, int]]):
        codes = raw_pairs((x, y) for x, y, _ in merges)
        order = np.argsort(codes)
        self.codes, self.times = codes[order], order.astype(np.int32)
        self.merged = np.array([raw_symbol(m) for _, _, m in merges], dtype=np.uint32)

    def time_of(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.times[at], np.int32(NEVER))

    def due(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """When each symbol is merged with the next one of its word."""
        times = np.full(len(symbols), NEVER, dtype=np.int32)
        if len(symbols) > 1:
            inside = np.flatnonzero(word[:-1] == word[1:])
            wide = symbols.astype(np.uint64)
            times[inside] = self.time_of(wide[inside] << np.uint64(32) | wide[inside + 1])
        return times

    def run(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' symbols after the merges, and how many each word has."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        times, done = self.due(symbols, word), []
        while len(symbols):
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            lengths = np.diff(begins, append=len(word))
            first = np.minimum.reduceat(times, begins)
            active = np.repeat(first < NEVER, lengths)
            earliest = np.repeat(first, lengths)
            if not active.all():
                done.append((symbols[~active], word[~active]))
                symbols, word, times, earliest = symbols[active], word[active], times[active], earliest[active]
            if not len(symbols):
                break
            places = np.flatnonzero(times == earliest)
            # In a chain of places that touch each other every second one is taken.
            head = np.ones(len(places), dtype=bool)
            head[1:] = np.diff(places) > 1
            numbers = np.arange(len(places))
            places = places[(numbers - np.maximum.accumulate(np.where(head, numbers, 0))) % 2 == 0]
            symbols[places] = self.merged[times[places]]
            kept = np.ones(len(symbols), dtype=bool)
            kept[places + 1] = False
            symbols, word, times, earliest = symbols[kept], word[kept], times[kept], earliest[kept]
            places -= np.arange(len(places))
            changed = np.unique(np.concatenate([places, np.maximum(places - 1, 0)]))
            last = changed == len(symbols) - 1
            times[changed[last]] = NEVER
            changed = changed[~last]
            same = word[changed] == word[changed + 1]
            wide = symbols[changed].astype(np.uint64) << np.uint64(32) | symbols[changed + 1].astype(np.uint64)
            found = self.time_of(wide)
            times[changed] = np.where(same & (found > earliest[changed]), found, np.int32(NEVER))
        symbols = np.concatenate([np.empty(0, dtype=np.uint32), *(s for s, _ in done)])
        word = np.concatenate([np.empty(0, dtype=np.int64), *(w for _, w in done)])
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))


def apply_merges(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """(symbols, n) after merges in their order; words of one symbol are left out."""
    rules: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for time, (left, right, merged) in enumerate(merges):
        rules[left, right].append((time, merged))
    shared = words.sparkSession.sparkContext.broadcast((dict(rules), merges))

    def queued(word: str, rules: dict) -> str:
        return "".join(map(symbol, replayed(ids_of(word), rules)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, merges = shared.value
        sweeps = Sweeps(merges) if len(rules) == len(merges) else None
        for batch in batches:
            found = batch.column(0)
            if sweeps is None:
                found = pa.array([queued(w, rules) for w in found.to_pylist()], pa.string())
            elif len(found):
                symbols, sizes = raw_symbols(found)
                long = sizes > SWEPT_SYMBOLS
                if long.any():
                    rest = np.flatnonzero(long)
                    spelled = pa.array([queued(w, rules) for w in found.take(pa.array(rest)).to_pylist()], pa.string())
                    short = from_raw(*sweeps.run(symbols[np.repeat(~long, sizes)], sizes[~long]))
                    order = np.argsort(np.concatenate([np.flatnonzero(~long), rest]))
                    found = pa.concat_arrays([short, spelled]).take(pa.array(order))
                else:
                    found = from_raw(*sweeps.run(symbols, sizes))
            yield pa.RecordBatch.from_arrays([found, batch.column(1)], ["symbols", "n"])

    return words.select("symbols", "n").mapInArrow(run, "symbols string, n bigint").where(F.length("symbols") > 1)


def train(counts: DataFrame, vocab_size: int) -> Vocabulary:
    """Greedy byte-pair training on (word, n): most frequent pair first, ties by smaller ids.

    A round counts all pairs, brings the leading ones to the driver and there takes all merges
    that rank before the first one left out, on the runs of these hot pairs (``merges_before``).
    The number of hot pairs follows what their runs take, at most RUN_SYMBOLS symbols; a single
    pair always fits. The merged word table is written to the shared folder, and the one before is
    removed.
    """
    counts = materialise(counts, "word-counts")
    alphabet = alphabet_of(counts)
    tokens = [*SPECIALS, *alphabet]
    known = {t: i for i, t in enumerate(tokens)}
    merges: list[tuple[int, int, int]] = []
    as_symbols = "".join(symbol(known[c]) for c in alphabet)
    words = counts.select(
        F.translate("word", "".join(alphabet), as_symbols).alias("symbols"), "n"
    ).where(F.length("symbols") > 1)
    current, hot = materialise(words, "symbols"), HOT_PAIRS
    discard(counts)
    while len(tokens) < vocab_size:
        ranked = leading_pairs(pair_counts(current), hot + 1)
        if not ranked:
            break
        table, bound, hot = _runs_that_fit(current, ranked, hot)
        batch = merges_before(table, bound, tokens, known, vocab_size)
        merges += batch
        previous, current = current, materialise(apply_merges(current, batch), "symbols")
        discard(previous)
    discard(current)
    return Vocabulary(tokens, merges)


def _runs_that_fit(
    words: DataFrame, ranked: list[tuple[int, tuple[int, int]]], hot: int
) -> tuple[RunTable, tuple[int, tuple[int, int]], int]:
    """Runs of the first ``hot`` pairs or fewer, the first pair left out, and next round's ``hot``."""
    while True:
        pairs = {symbol(a) + symbol(b) for _, (a, b) in ranked[:hot]}
        bound = ranked[hot] if hot < len(ranked) else (0, (0, 0))
        runs = hot_runs(words, pairs).persist()
        size = runs.agg(F.sum(F.length("run"))).first()[0]
        if size <= RUN_SYMBOLS or hot == 1:
            held = runs.select("run", "n").toArrow()
            runs.unpersist()
            grown = hot * (16 if size < RUN_SYMBOLS // 256 else 4 if size < RUN_SYMBOLS // 8 else 2 if size < RUN_SYMBOLS // 3 else 1)
            return RunTable(held["run"], held["n"].to_numpy()), bound, min(grown, MAX_HOT_PAIRS)
        runs.unpersist()
        hot = max(1, hot // 4)


def merge_word(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges lowest rank first, leftmost first, to one word's symbol ids."""
    n = len(ids)
    ids, following, preceding = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    waiting: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and following[i] < n:
            rule = ranks.get((ids[i], ids[following[i]]))
            if rule:
                heapq.heappush(waiting, (rule[0], i, ids[i], ids[following[i]]))

    for i in range(n - 1):
        offer(i)
    while waiting:
        _, i, left, right = heapq.heappop(waiting)
        j = following[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue
        ids[i], ids[j] = ranks[left, right][1], -1
        following[i] = following[j]
        if following[j] < n:
            preceding[following[j]] = i
        offer(preceding[i])
        offer(i)
    return [t for t in ids if t >= 0]


class WordEncoder:
    """Ids of single words, remembered up to MEMO_WORDS of them.

    Characters outside the vocabulary become one unknown id per run of them.
    """

    def __init__(self, vocabulary: Vocabulary, first_id: int = 0):
        self._ranks = {(a, b): (r, m) for r, (a, b, m) in reversed(list(enumerate(vocabulary.merges)))}
        self._ids = {t: i for i, t in enumerate(vocabulary.tokens) if i >= len(SPECIALS) and len(t) == 1}
        self._first_id = first_id
        self._memo: dict[str, list[int]] = {}

    def encode(self, word: str, remember: bool = True) -> list[int]:
        found = self._memo.get(word)
        if found is None:
            spelled: list[int] = []
            for c in word:
                i = self._ids.get(c, UNK)
                if i != UNK or spelled[-1:] != [UNK]:
                    spelled.append(i)
            found = [i + self._first_id for i in merge_word(spelled, self._ranks)]
            if remember and len(self._memo) < MEMO_WORDS:
                self._memo[word] = found
        return found


# What a piece means for the blanks beside it: nothing, not written, a blank, a token that implies a blank
# after it, and one that implies blanks on both sides.
PLAIN, UNWRITTEN, BLANK, BLANK_AFTER, BLANK_AROUND = range(5)


class Speller(Protocol):
    """Units of a piece, each a word in the vocabulary's letters or an id, and what it means for blanks."""

    def units(self, piece: str) -> list[str | int]: ...

    def word(self, text: str) -> str: ...

    def kind(self, piece: str) -> int: ...


class PieceEncoder:
    """Ids of single pieces of a text, as bytes, remembered up to MEMO_WORDS of them."""

    def __init__(self, vocabulary: Vocabulary, first_id: int, speller: Speller):
        self._words, self._speller = WordEncoder(vocabulary, first_id), speller
        self._memo: dict[str, tuple[bytes, int]] = {}

    def known(self, piece: str) -> tuple[bytes, int] | None:
        return self._memo.get(piece)

    def encode(self, piece: str, units: list[str | int] | None = None) -> tuple[bytes, int]:
        """A piece's ids and kind; ``units`` are those of a piece that the speller does not know."""
        found = self._memo.get(piece)
        if found is None:
            kind = self._speller.kind(piece) if units is None else PLAIN
            units = self._speller.units(piece) if units is None else units
            several, ids = len(units) > 1, []
            for u in units:
                ids.extend([u] if isinstance(u, int) else self._words.encode(self._speller.word(u), several))
            found = np.array(ids, dtype=np.int32).tobytes(), kind
            if len(self._memo) < MEMO_WORDS:
                self._memo[piece] = found
        return found


_encoders: dict[str, PieceEncoder] = {}


_shared: dict[int, tuple] = {}


def shared_vocabulary(spark: SparkSession, vocabulary: Vocabulary) -> tuple:
    """A vocabulary's broadcast and the name of its encoders, the same for every job of a session."""
    app = spark.sparkContext.applicationId
    held = _shared.get(id(vocabulary))
    if held is None or held[0] is not vocabulary or held[1] != app:
        if len(_shared) >= SHARED_VOCABULARIES:
            _shared.clear()
        held = _shared[id(vocabulary)] = (vocabulary, app, spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex)
    return held[2:]


def encoder_of(job: str, vocabulary: Vocabulary, first_id: int, speller: Speller) -> PieceEncoder:
    """The encoder of a job in this worker process: its tasks share the pieces that they have met."""
    key = f"{job}-{first_id}-{speller}"
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(vocabulary, first_id, speller)
    return _encoders[key]


def _placed(pieces: pa.ListArray, odd: pa.ListArray | None, encoder: PieceEncoder) -> pa.ListArray:
    """Ids of each row. ``odd`` has the units of its pieces beyond ASCII, in order."""
    entries = pieces.flatten().dictionary_encode()
    which, known = entries.indices.to_numpy(), entries.dictionary.to_pylist()
    row = np.repeat(np.arange(len(pieces)), pc.list_value_length(pieces).fill_null(0).to_numpy())
    found: list[tuple[bytes, int] | None] = [None] * len(known)
    if odd is not None:
        beyond = np.array([not p.isascii() for p in known], dtype=bool)
        if beyond.any():
            units = odd.flatten()
            for i, at in zip(*(x.tolist() for x in np.unique(which[beyond[which]], return_index=True)), strict=True):
                found[i] = encoder.known(known[i]) or encoder.encode(
                    known[i], [u["fixed"] if u["word"] is None else u["word"] for u in units[at].as_py()]
                )
    found = [encoder.encode(p) if f is None else f for p, f in zip(known, found, strict=True)]
    ids = np.frombuffer(b"".join(f[0] for f in found), dtype=np.int32)
    sizes = np.array([len(f[0]) // 4 for f in found], dtype=np.int64)
    kinds = np.array([f[1] for f in found], dtype=np.int8)
    if (kinds != PLAIN).any():
        written = kinds[which] != UNWRITTEN
        which, row = which[written], row[written]
        kind, same = kinds[which], row[1:] == row[:-1]
        implied = np.zeros(len(which), dtype=bool)
        implied[1:] |= (kind[:-1] >= BLANK_AFTER) & same
        implied[:-1] |= (kind[1:] == BLANK_AROUND) & same
        wanted = (kind != BLANK) | ~implied
        which, row = which[wanted], row[wanted]
    taken = sizes[which]
    ends = np.cumsum(taken)
    at = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - taken), taken) + np.arange(int(taken.sum()))
    rows = np.searchsorted(row, np.arange(len(pieces) + 1))
    offsets = np.concatenate([[0], ends])[rows].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[at], pa.int32()))


def place_ids(
    pieces: DataFrame, vocabulary: Vocabulary, speller: Speller, first_id: int, *keys: str
) -> DataFrame:
    """Documents' ids from their pieces (ARRAY<STRING>), without a shuffle.

    The vocabulary travels to the tasks once, each worker remembers the pieces that it has met, and
    a document never leaves its row. A column ``odd`` (ARRAY<ARRAY<STRUCT<word STRING, fixed INT>>>)
    has the units of the pieces beyond ASCII; without it the speller knows all pieces.
    """
    shared, job = shared_vocabulary(pieces.sparkSession, vocabulary)
    columns = {"_pieces": "pieces", **({"_odd": "odd"} if "odd" in pieces.columns else {})}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(job, shared.value, first_id, speller)
        for batch in batches:
            for start in range(0, batch.num_rows, ENCODED_ROWS):
                part = batch.slice(start, ENCODED_ROWS)
                ids = _placed(part.column("_pieces"), part.column("_odd") if "_odd" in columns else None, encoder)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), ids], [*keys, "ids"])

    rows = pieces.select(*keys, *(F.col(c).alias(name) for name, c in columns.items()))
    schema = T.StructType([*pieces.select(*keys).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def word_units(words: Column) -> Column:
    return F.transform(
        words, lambda w: F.struct(w.alias("word"), F.lit(None).cast("int").alias("fixed"))
    )
