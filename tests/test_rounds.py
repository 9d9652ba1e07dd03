"""Rounds of training on the driver beside one merge at a time, without a session."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from models import greedy_bpe

from millrace.operators import bpe


def runs_of(words, hot):
    found = Counter()
    for ids, n in words:
        begin = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or tuple(ids[i - 1 : i + 1]) not in hot:
                if i - begin > 1:
                    found["".join(map(bpe.symbol, ids[begin:i]))] += n
                begin = i
    return bpe.RunTable(pa.chunked_array([pa.array(list(found), pa.string())]), np.array(list(found.values())))


def trained(counts, size, hot):
    tokens = [*bpe.SPECIALS, *sorted({c for w in counts for c in w})]
    known = {t: i for i, t in enumerate(tokens)}
    words, merges, rounds = [([known[c] for c in w], n) for w, n in counts.items()], [], 0
    while len(tokens) < size:
        pairs = Counter()
        for ids, n in words:
            for pair in zip(ids, ids[1:]):
                pairs[pair] += n
        ranked = sorted((-n, p) for p, n in pairs.items())
        if not ranked:
            break
        taken = {p for _, p in ranked[:hot]}
        bound = ranked[hot] if hot < len(ranked) else (0, (0, 0))
        batch = bpe.merges_before(runs_of(words, taken), bound, tokens, known, size)
        assert batch
        rules = {}
        for time, (a, b, m) in enumerate(batch):
            rules.setdefault((a, b), []).append((time, m))
        words = [(bpe.replayed(ids, rules), n) for ids, n in words]
        merges += batch
        rounds += 1
    return tokens, merges, rounds


@pytest.mark.parametrize("hot", [1, 2, 4, 9, 30])
def test_rounds_equal_one_merge_at_a_time(hot):
    for seed in range(80):
        rng = random.Random(1000 * hot + seed)
        letters, weights = "abcd"[: rng.randint(1, 4)], [6, 3, 2, 1]
        longest = rng.choice([12, 12, 60])
        counts = {
            "".join(rng.choices(letters, weights[: len(letters)], k=rng.randint(1, longest))): rng.randint(1, 4)
            for _ in range(rng.randint(3, 40))
        }
        size = rng.choice([12, 40, 1000])
        tokens, merges = greedy_bpe(counts, size)
        found = trained(counts, size, hot)
        assert found[:2] == (tokens, merges), (hot, seed)


def test_many_merges_make_a_round():
    rng = random.Random(1)
    counts = {"".join(rng.choices("abcdefgh", [9, 7, 5, 4, 3, 2, 1, 1], k=rng.randint(2, 9))): rng.randint(1, 9) for _ in range(2000)}
    tokens, merges = greedy_bpe(counts, 400)
    found = trained(counts, 400, 64)
    assert found[:2] == (tokens, merges) and found[2] <= len(merges) / 10


def test_a_token_spelled_anew_does_not_go_back_in_time():
    # xc is merged before c comes up in the word, and once more after.
    rules = {(5, 7): [(0, 8), (2, 9)], (6, 6): [(1, 7)]}
    assert bpe.replayed([5, 6, 6], rules) == [9]
    assert bpe.replayed([5, 7, 5, 6, 6], rules) == [8, 9]
    assert bpe.replayed([6, 6, 6, 6, 6], rules) == [7, 7, 6]


def swept(words, merges):
    """Words after a round's merges in sweeps, by way of their bytes."""
    packed = pa.array(["".join(map(bpe.symbol, w)) for w in words], pa.string())
    return [bpe.ids_of(w) for w in bpe.from_raw(*bpe.Sweeps(merges).run(*bpe.raw_symbols(packed))).to_pylist()]


def test_sweeps_equal_the_queue():
    for seed in range(60):
        rng = random.Random(seed)
        merges, size = [], 4
        while len(merges) < 12:
            pair = rng.randrange(size), rng.randrange(size)
            if pair not in {m[:2] for m in merges}:
                merges.append((*pair, size))
                size += 1
        # A round may end with a token spelled anew.
        left = rng.randrange(size)
        merges.append((left, size - 1, rng.randrange(4, size)))
        rules = {(a, b): [(t, m)] for t, (a, b, m) in enumerate(merges)}
        words = [rng.choices(range(4), [8, 3, 2, 1], k=rng.randint(0, 40)) for _ in range(50)] + [[0] * n for n in range(9)]
        assert swept(words, merges) == [bpe.replayed(w, rules) for w in words]


def test_merges_applied_to_long_words_and_repeated_rules(spark):
    words = [[0, 0, 1] * 200, [0, 1], [1, 0, 0, 1], [2]]
    frame = spark.createDataFrame([("".join(map(bpe.symbol, w)), i + 1) for i, w in enumerate(words)], "symbols string, n bigint")
    for merges in ([(0, 1, 3), (0, 3, 4)], [(0, 1, 3), (0, 0, 1), (0, 1, 4)]):
        rules = {}
        for time, (a, b, m) in enumerate(merges):
            rules.setdefault((a, b), []).append((time, m))
        expected = {(i + 1, tuple(bpe.replayed(w, rules))) for i, w in enumerate(words)}
        found = {(r.n, tuple(bpe.ids_of(r.symbols))) for r in bpe.apply_merges(frame, merges).collect()}
        assert found == {(n, w) for n, w in expected if len(w) > 1}


def test_hot_runs_are_cut_where_a_pair_is_not_hot(spark):
    rng = random.Random(3)
    words = [(rng.choices(range(5), k=rng.randint(1, 9)), rng.randint(1, 4)) for _ in range(300)]
    hot = {(0, 1), (1, 1), (2, 3), (3, 0)}
    frame = spark.createDataFrame([("".join(map(bpe.symbol, w)), n) for w, n in words], "symbols string, n bigint")
    found = bpe.hot_runs(frame, {bpe.symbol(a) + bpe.symbol(b) for a, b in hot}).collect()
    expected = Counter()
    for ids, n in words:
        begin = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or tuple(ids[i - 1 : i + 1]) not in hot:
                if i - begin > 1:
                    expected["".join(map(bpe.symbol, ids[begin:i]))] += n
                begin = i
    assert {r.run: r.n for r in found} == dict(expected) and len(found) == len(expected)
