"""SimHash, embedding and decontamination operators beside brute force."""

import itertools

import numpy as np
import pytest

from millrace.llm import blocks, decontam, embeddup, simhash
from millrace.session import materialise

DOC = "doc_id bigint, text string, fp int, key int"


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    index = simhash.codeword(words)
    assert index.min() >= 0 and index.max() < 4096
    centre = {int(i): int(w) for i, w in zip(index, words, strict=True)}
    errors = simhash._error_of_syndrome()[1]
    assert len(set(errors.tolist())) == 2048
    assert max(int(e).bit_count() for e in errors) == 3
    assert len(centre) > 1000


def test_all_pairs_within_three_bits_meet():
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 62), 1 << 62, 300)
    for bits in range(4):
        flips = np.array([sum(1 << int(b) for b in rng.choice(63, bits, replace=False)) for _ in base], dtype=np.int64)
        stored, looked = simhash.golay_keys(base ^ flips)[0], simhash.golay_keys(base)[1]
        stored, looked = [[row[keep] for row, keep in zip(*side, strict=True)] for side in (stored, looked)]
        assert all(set(s.tolist()) & set(k.tolist()) for s, k in zip(stored, looked, strict=True))
        assert max(map(len, stored)) <= 12 and max(map(len, looked)) <= 72
        assert all(len(set(k.tolist())) == len(k) for k in looked)


def test_keys_are_written_once_with_and_without_a_heavy_bucket(spark, monkeypatch):
    written = []
    monkeypatch.setattr(simhash, "materialise", lambda df, label: written.append(label) or materialise(df, label))
    rng = np.random.default_rng(9)
    far = rng.integers(-(1 << 62), 1 << 62, 200).tolist()
    for near in (0, 60):
        written.clear()
        fps = far + [far[0] ^ sum(1 << 43 + int(b) for b in rng.choice(20, 3, replace=False)) for _ in range(near)]
        frame = spark.createDataFrame([(f,) for f in set(fps)], "fp bigint")
        links = simhash.close_links(frame)
        assert written.count("golay-keys") == 1 and ("blocks" in written) == bool(near)
        assert "MapInArrow" not in links._jdf.queryExecution().executedPlan().toString()


def close(fps):
    return [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]


@pytest.mark.parametrize("light", [1, 32])
def test_simhash_components_equal_brute_force(spark, monkeypatch, light):
    monkeypatch.setattr(simhash, "LIGHT", light)
    monkeypatch.setattr(blocks, "BLOCK", 8)
    rng = np.random.default_rng(3)
    fps = {0}
    for centre in rng.integers(-(1 << 62), 1 << 62, 6).tolist():
        for _ in range(25):
            fps.add(centre ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)))
    frame = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    links = [tuple(r) for r in simhash.close_links(frame).collect()]
    assert components(fps, links) == components(fps, close(fps))


def test_simhash_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "One two"), (4, "One two"), (None, "one"), (7, "a b c " * 30_000)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], DOC)
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    assert by_id[1][1:] == ("0" * 16, 1) and by_id[2][2] == 1
    assert by_id[None][2] == 3 and by_id[3][1] == by_id[None][1]
    assert by_id[4][1] == f"{simhash.simhash64(b'one two'):016x}"
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == [1, 3, 4, 4, 7]


VEC = "vec_id bigint, embedding array<float>, label int, v int, t int"


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "LIGHT", 4)
    monkeypatch.setattr(blocks, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows = []
    for centre in rng.normal(size=(8, 24)):
        for _ in range(12):
            rows.append([float(x) for x in (centre + rng.normal(0, rng.choice([0.02, 0.2]), 24)).astype(np.float32)])
    rows += [rows[0]] * 6
    data = [(i, v, i % 3 if i < 90 else None, 0, 0) for i, v in enumerate(rows)]
    data += [(900, None, 1, 0, 0), (901, [0.0, 0.0], 1, 0, 0), (902, [1.0, None], 1, 0, 0), (903, [float("nan"), 1.0], 1, 0, 0)]
    data += [(904, [], 1, 0, 0), (905, [1.0, 2.0], 1, 0, 0), (905, [1.0, 2.0], 1, 0, 0), (None, [1.0, 2.0], 1, 0, 0)]
    got = embeddup.near_duplicates(spark.createDataFrame(data, VEC)).collect()
    links, good = [], [(n, np.array(d[1], dtype=float), d[2]) for n, d in enumerate(data) if d[1] and d[2] is not None]
    good = [(n, v / np.linalg.norm(v), y) for n, v, y in good if np.isfinite(v).all() and v.any()]
    for (i, v, x), (j, w, y) in itertools.combinations(good, 2):
        if x == y and len(v) == len(w) and v @ w >= 0.93:
            links.append((i, j))
    root = components(range(len(data)), links)
    least = {}
    for n, d in enumerate(data):
        if d[0] is not None:
            least[root[n]] = min(least.get(root[n], 1 << 60), d[0])
    expected = sorted(
        ((d[0], sum(n in p for p in links), least.get(root[n]), d[0] == least.get(root[n])) for n, d in enumerate(data)), key=str
    )
    assert sorted(map(tuple, got), key=str) == expected
    assert embeddup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = int(rng.integers(len(words)))
        kind = rng.integers(3)
        if kind == 0:
            words[at] = f"x{rng.integers(10**6)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"y{rng.integers(10**6)}")
    return words


def test_decontamination_recall_and_exact_check(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [list(rng.choice(vocabulary, rng.integers(15, 60))) for _ in range(30)]
    docs, planted = [], set()
    for n in range(300):
        words = list(rng.choice(vocabulary, 120))
        if n % 2:
            item = int(rng.integers(30))
            at = int(rng.integers(100))
            words[at:at] = edited(rng, items[item], int(rng.integers(0, decontam.allowed(len(items[item])) + 1)))
            planted.add((n, item))
        docs.append((n, ", ".join(words).upper(), 0, 0))
    frame = spark.createDataFrame(docs, DOC)
    benchmark = spark.createDataFrame([(i, " ".join(t), 1) for i, t in enumerate(items)], "item_id bigint, text string, doc_id int")
    got = decontam.contaminated(frame, benchmark, item_block=16).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(found & planted) >= 0.95 * len(planted)
    hashed = [decontam.word_hashes(" ".join(t)) for t in items]
    text = {d[0]: d[1] for d in docs}
    for r in got:
        item = hashed[r["item_id"]]
        near = decontam.word_hashes(text[r["doc_id"]][r["start"] : r["end"]])
        assert decontam._last_row(item, near)[-1] == r["distance"] <= decontam.allowed(len(item))


def test_decontamination_finds_every_passage_at_the_limit():
    rng = np.random.default_rng(11)
    fill = lambda n: rng.integers(1 << 20, 1 << 40, n).astype(np.uint64)
    items, docs, planted = [rng.integers(1, 3000, n).astype(np.uint64) for n in range(5, 60)], [], set()
    for number, item in enumerate(items):
        size, k = len(item), decontam.allowed(len(item))
        at, spread = rng.choice(size, k, replace=False), item.copy()
        spread[at] = fill(k)
        even = item.copy()
        even[[size * (j + 1) // (k + 1) - 1 for j in range(k)]] = fill(k)
        inner = item[k // 2 : size - (k - k // 2)]
        replaced = np.concatenate([fill(k // 2), inner, fill(k - k // 2)])
        middle = np.concatenate([item[: size // 2], fill(k), item[size // 2 :]])
        for passage in (inner, replaced, spread, even, middle, item[k:], item[: size - k], np.delete(item, at)):
            planted.add((len(docs), number))
            docs.append(np.concatenate([fill(70), passage, fill(70)]))
        over = np.concatenate([fill(k // 2), item[k // 2 : size - (k - k // 2) - 1], fill(k - k // 2 + 1)])
        docs.append(np.concatenate([fill(70), over, fill(70)]))
    finder = decontam.Finder(items, decontam.SIMILARITY)
    hits = finder.find(docs)
    assert pigeonhole(items, docs) == planted
    found = {h[:2] for h in hits}
    # Recall in each of the eight edit patterns, and nothing beyond the limit.
    assert found <= planted
    for pattern in range(8):
        cases = {(doc, item) for doc, item in planted if doc % 9 == pattern}
        assert len(cases) == len(items) and len(found & cases) >= 0.99 * len(cases), pattern
    assert all(h[2] <= decontam.allowed(len(items[h[1]])) for h in hits)


def edit_distance(item, words):
    """Of the item to the best stretch of the words, in plain Python."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        before, row = row, [i] + [0] * len(words)
        for j, b in enumerate(words, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a != b))
    return min(row)


def pigeonhole(items, docs):
    """Pairs within the limit: k edits leave one of k + 1 pieces whole, so all pieces are looked up."""
    pieces, longest = {}, 0
    for number, item in enumerate(items):
        k = decontam.allowed(len(item))
        edges = [len(item) * p // (k + 1) for p in range(k + 2)]
        for first, end in itertools.pairwise(edges):
            pieces.setdefault(tuple(item[first:end].tolist()), []).append((number, first))
            longest = max(longest, end - first)
    found = set()
    for doc, words in enumerate(docs):
        words = words.tolist()
        for at in range(len(words)):
            for size in range(1, longest + 1):
                for number, first in pieces.get(tuple(words[at : at + size]), ()):
                    k = decontam.allowed(len(items[number]))
                    around = words[max(0, at - first - k) : at - first + len(items[number]) + k]
                    if (doc, number) not in found and edit_distance(items[number].tolist(), around) <= k:
                        found.add((doc, number))
    return found


@pytest.mark.parametrize("size", [4, 7, 12, 19, 38, 59])
def test_random_edits_at_the_limit_are_found(size):
    rng = np.random.default_rng(size)
    # Common words as in prose: a third of all words are one of ten.
    draw = lambda n: np.where(rng.random(n) < 0.33, rng.integers(1, 11, n), rng.integers(1, 5000, n)).astype(np.uint64)
    items, docs = [draw(size) for _ in range(150)], []
    for item in items:
        words, k = item.tolist(), decontam.allowed(size)
        for _ in range(k):
            at = int(rng.integers(0, len(words)))
            kind = rng.integers(3)
            if kind == 0:
                words[at] = int(rng.integers(1 << 20, 1 << 40))
            elif kind == 1:
                words.insert(at, int(rng.integers(1 << 20, 1 << 40)))
            else:
                del words[at]
        docs.append(np.concatenate([draw(40), np.array(words, dtype=np.uint64), draw(40)]))
    finder = decontam.Finder(items, decontam.SIMILARITY)
    found = {h[:2] for h in finder.find(docs)}
    expected = pigeonhole(items, docs)
    assert {(n, n) for n in range(150)} <= expected and found <= expected
    assert len(found) >= 0.99 * len(expected)


def test_walks_agree_until_an_edit_and_meet_again():
    rng = np.random.default_rng(4)
    words = rng.integers(1, 1 << 40, 60).astype(np.uint64)
    other = words.copy()
    other[10] = 7
    at = np.arange(30)
    met = 0
    for function in range(decontam.functions_for()):
        for (key, place), (key2, place2) in zip(
            decontam.walk(words, at, function, 24), decontam.walk(other, at, function, 24), strict=True
        ):
            # No difference while a walk has not come to the edit, and for walks that begin behind it.
            clear = (place < 10) | (at > 10)
            assert (key[clear] == key2[clear]).all() and (place[clear] == place2[clear]).all()
        met += (place[:10] == place2[:10]).mean()
    assert met / decontam.functions_for() > 0.5


def test_decontamination_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0, 0), (2, "", 0, 0), (None, "so A-b c d", 0, 0), (3, "a b c d " * 20_000, 0, 0), (3, "q", 0, 0)], DOC)
    items = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "  "), (4, "A B C D")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(d, i, 0) for d in (None, 3) for i in (1, 4)}
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [1, 2]
