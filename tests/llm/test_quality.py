"""The quality classifier: linear-time scores, gradient, held-out labels, odd input."""

import itertools

import numpy as np

from millrace.llm import quality
from millrace.llm.common import table

DOC = "doc_id bigint, text string, n_chars bigint, score int, predicted int, _y int, _id int"
LABEL = "doc_id bigint, quality int, text string"


def machine(size, seed=0):
    rng = np.random.default_rng(seed)
    return quality.Machine(0.25, rng.standard_normal(size).astype(np.float32), rng.standard_normal((size, 3)).astype(np.float32))


def test_sum_of_squares_equals_all_pairs():
    m, rng = machine(40), np.random.default_rng(1)
    sizes = [1, 5, 17]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    columns = np.concatenate([rng.choice(40, s, replace=False) for s in sizes])
    values = rng.random(len(columns)).astype(np.float32)
    for row, got in enumerate(m.raw(starts, columns, values)):
        c, x = columns[starts[row] : starts[row + 1]], values[starts[row] : starts[row + 1]]
        pairs = sum(m.factors[c[i]] @ m.factors[c[j]] * x[i] * x[j] for i, j in itertools.combinations(range(len(c)), 2))
        assert np.isclose(got, 0.25 + m.weights[c] @ x + pairs, atol=1e-4)


def test_interactions_are_learnt():
    # Label 1 only if exactly one of two features is there: no weights alone can tell.
    rows = [(a, b) for a in (0, 1) for b in (0, 1)] * 50
    y = np.array([a ^ b for a, b in rows], dtype=np.float64)
    starts = np.arange(0, 3 * len(rows), 2)[: len(rows) + 1]
    columns = np.array([c for a, b in rows for c in (a, 2 + b)])
    got = quality.train(starts, columns, np.ones(len(columns), dtype=np.float32), y, np.ones(len(y)), 4, epochs=200)
    assert ((got.raw(starts, columns, np.ones(len(columns), dtype=np.float32)) > 0) == (y == 1)).all()


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good, bad = [[r.score for r in rows if r.quality == q] for q in (1, 0)]
    assert len(bad) > 5 and sum(s >= 0.3 for s in good) >= 0.98 * len(good)
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_odd_rows(spark):
    words = "good plain words here"
    rows = [(n, f"{words} {n}" if n % 2 else f"{words} ### {n} !!!", 30) for n in range(60)]
    rows += [(None, words, None), (100, None, None), (101, "", 0), (102, "x" * 300_000, -5), (102, "x" * 300_000, -5)]
    docs = spark.createDataFrame([(*r, 7, 7, 7, 7) for r in rows], DOC)
    labels = [(n, n % 2, "t") for n in range(60)] + [(None, 1, "t"), (5, None, "t"), (7, 3, "t"), (9, 1, "t"), (9, 1, "t")]
    labels = spark.createDataFrame(labels, LABEL)
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[n].score > 0.5) == (n % 2 == 1) for n in range(60))
    assert by_id[None].held_out is False and len({r.score for r in got if r.doc_id == 102}) == 1
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0
    for few, share in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0)):
        assert {r.score for r in quality.score(docs, quality.fit(docs, few)).collect()} == {share}
    # A repeated id is one row of the sample; without the metadata column it is not used.
    same = docs.where("doc_id = 9")
    many = docs.unionByName(same).unionByName(same).drop("n_chars")
    model = quality.fit(many, labels)
    assert model.metadata == () and quality.score(many, model).count() == len(rows) + 2
