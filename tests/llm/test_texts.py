"""Toxicity, language, licence, personal-data and language-model operators on small tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import crf, langid, lblm, licenses, pii, toxicity

DOC = "doc_id bigint, text string, lang string, held_out int, row int, word string"
ODD = [(1000, None), (1001, ""), (1002, "123 456"), (None, "plain words here"), (1003, "x y " * 40_000), (1003, "again")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (6 - len(r))) for r in rows], DOC)


def brute_marginals(emission, first, chain):
    """Marginals by summing over all taggings of each text."""
    cuts = [*np.flatnonzero(first), len(emission)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        n, mass, total = b - a, np.zeros(b - a), 0.0
        for code in range(2**n):
            tags = [code >> i & 1 for i in range(n)]
            s = chain.start[tags[0]] + sum(e for e, t in zip(emission[a:b], tags, strict=True) if t)
            s += sum(chain.transition[x, y] for x, y in zip(tags, tags[1:], strict=False))
            total += math.exp(s)
            mass += math.exp(s) * np.array(tags)
        out.append(mass / total)
    return np.concatenate(out)


def test_forward_backward_equals_enumeration(monkeypatch):
    monkeypatch.setattr(crf, "BLOCK", 4)
    rng = np.random.default_rng(1)
    chain = crf.Chain(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    emission = rng.normal(size=30)
    first = np.zeros(30, dtype=bool)
    first[[0, 1, 9, 20]] = True
    got, pairs = crf.forward_backward(emission, first, chain, pairs=True)
    assert np.allclose(got, brute_marginals(emission, first, chain))
    assert pairs.sum() == pytest.approx(26)


def test_toxicity_learns_and_keeps_every_row(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(80)]
    rows, labels = [], []
    for n in range(400):
        text = list(rng.choice(words, 40))
        toxic = n % 5 == 0
        if toxic:
            text[3:3] = ["grumbel", "blarg"]
        rows.append((n, " ".join(text)))
        labels.append((n, 1, int(toxic)))
    docs = frame(spark, rows + ODD)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5000, 0, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(ODD)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] is not None and r["doc_id"] < 1000:
            assert r["predicted"] == (r["doc_id"] % 5 == 0)
    text = dict(rows)
    spans = {r["doc_id"]: r["spans"] for r in got}
    start, end = map(int, spans[5].split(":"))
    assert text[5][start:end] == "grumbel blarg"
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 320 + len(ODD)


def test_toxicity_without_labels(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert {r["score"] for r in got} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_toxicity_stage_keeps_all_without_both_classes(spark):
    docs = frame(spark, [(0, "a clean text"), (1, "another one"), *ODD])
    for marks in ([], [(0, 1), (1, 1)]):
        kept = toxicity.drop_toxic(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
        assert kept.columns == docs.columns and kept.count() == docs.count()


def test_samples_take_one_row_of_a_repeated_id(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(langid, "train", lambda texts, labels: taken.update(lang=(texts, labels)))
    monkeypatch.setattr(toxicity, "Lexicon", lambda texts: taken.setdefault("toxic", texts) and None)
    monkeypatch.setattr(toxicity, "train", lambda *_: None)
    monkeypatch.setattr(toxicity, "token_labels", lambda *_: None)
    monkeypatch.setattr(toxicity, "Tagger", lambda _: type("T", (), {"tag": lambda self, t: [np.zeros(0)] * len(t)})())
    inside = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    hot, others = inside[0], inside[1:40]
    rows = [(hot, f"same id {n:03d}", "en") for n in range(150)] + [(i, f"text {i}", "en" if i % 2 else "de") for i in others]
    docs = frame(spark, rows)
    langid.fit(docs)
    texts, labels = taken["lang"]
    assert len(texts) == 40 and [t for t in texts if t.startswith("same")] == ["same id 000"] and set(labels) == {"en", "de"}
    known = [(i, i % 2) for i in others] + [(hot, 1)] * 5 + [(hot, 0)]
    toxicity.fit(docs, spark.createDataFrame(known, "doc_id bigint, toxic int"))
    assert sorted(taken["toxic"]) == sorted(["same id 000"] + [f"text {i}" for i in others])


def test_language_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() > 20
    assert got.where("lang = lang_pred").count() >= 0.9 * got.count()


def test_language_edge_cases(spark):
    rows = [(i, t * 3, y) for i, (t, y) in enumerate([("the and of with ", "en"), ("ñandú él está ", "es")] * 20)]
    docs = frame(spark, rows + [(*r, None) for r in ODD])
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == y for i, _, y in rows)
    assert {by_id[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and by_id[1001]["score"] == 0
    assert langid.identify(docs, langid.fit(docs.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_kernel_is_linear_in_presence():
    texts = ["one two three", "uno dos tres", "one three", "dos uno"]
    model = langid.train(texts, ["en", "es", "en", "es"], landmarks=3)
    names, scores = langid.predict(model, texts)
    assert names == ["en", "es", "en", "es"] and (scores > 0.5).all()
    n, m = langid.grams(langid.letter_codes("abc")), langid.grams(langid.letter_codes("a  b!"))
    assert len(n) == 4 + 3 + 2 and len(set(n.tolist())) == 9
    assert len(m) == 4 + 2


def base_licenses(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        parts = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


FSF = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {kind} License as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version."""
NOTICES = [
    ("gpl-3", FSF.format(kind="General Public", version="3")),
    ("gpl-2", FSF.format(kind="General Public", version="2")),
    ("lgpl", FSF.format(kind="Lesser General Public", version="2.1")),
    ("lgpl", FSF.format(kind="Lesser General Public", version="3")),
    ("agpl-3", FSF.format(kind="Affero General Public", version="3")),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0""",
    ),
    (
        "mpl-2",
        """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "bsd",
        """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    ),
    ("mit", "// SPDX-License-Identifier: MIT"),
    ("apache-2", "# SPDX-License-Identifier: Apache-2.0"),
    ("gpl-2", "/* SPDX-License-Identifier: GPL-2.0-only */"),
    ("gpl-3", "/* SPDX-License-Identifier: GPL-3.0-or-later */"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl-2", "SPDX-License-Identifier: MPL-2.0"),
]


def test_standard_notices_have_their_labels_and_no_others(spark):
    rows = [(n, f"package x\n\n/* {notice} */\nfunc main() {{}}") for n, (_, notice) in enumerate(NOTICES)]
    plain = [
        (100, "the gnu general public has a license as published, either version 3 or 4 of something free"),
        (101, "a license identifier is a name; spdx lists them: mit, isc"),
    ]
    docs = spark.createDataFrame(rows + plain, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for n, (label, _) in enumerate(NOTICES):
        assert got[n]["labels"] == label and 0 < got[n]["score"] <= 1, NOTICES[n]
    assert got[100]["labels"] == got[101]["labels"] == ""


def test_licenses_equal_brute_force_and_add_labels(spark):
    texts = [t.text for t in licenses.TEMPLATES]
    rows = [(i, f"Ünïted {t.upper()}; MIT and the-license. {t}") for i, t in enumerate(texts)]
    rows += [(50, "CC BY-NC-4.0 cc by nc, under the MIT License; Apache License, Version 2.0"), (51, "the gnu license version")]
    docs = frame(spark, rows + ODD + [(52, "nothing at all here")] * 30)
    got = licenses.scan(docs)
    text = {}
    for i, t in rows + ODD:
        text.setdefault(i, []).append(base_licenses(t))
    seen = got.where(F.col("doc_id").isNull() | (F.col("doc_id") != 52)).collect()
    assert len(seen) == len(rows) + len(ODD)
    for r in seen:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in text[r["doc_id"]]
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        if r["doc_id"] is not None and r["doc_id"] < len(texts):
            assert licenses.TEMPLATES[r["doc_id"]].label in r["labels"].split(",") and 0 < r["score"] <= 1
        if r["doc_id"] == 51:
            assert r["labels"] == "" and r["score"] == 0
    assert licenses.scan(docs.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group())):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_plain_spans_equal_the_patterns():
    rng = np.random.default_rng(3)
    for alphabet in ("ab1.@@-.+ 2_é", "0123.. -+(", "4 1-"):
        for _ in range(1500):
            text = "".join(rng.choice(list(alphabet), 60))
            assert pii.plain_spans(text) == base_spans(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.plain_spans("a" * 200_000 + "1" * 200_000) == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john (at) example (dot) com now", "email:5:32"),
        ("john at example dot com", "email:0:23"),
        ("jоhn@exаmple.com!", "email:0:16,email:2:8"),
        ("ip 10 dot 0 dot 0 dot 255 or", "ip:3:25"),
        ("call plus one five five five one two three four five six seven eight ok", "phone:5:68"),
        ("four" + " one" * 15 + " end", "card:0:64"),
        ("look at there. And at home", ""),
        ("１９２.168.0.1", "ip:0:11"),
    ],
)
def test_disguised_spans_map_back(text, found):
    plain = pii.plain_spans(text)
    listed = pii.listed(sorted(plain + pii.disguised_spans(text, plain)))
    if "оhn" in text:
        assert listed.startswith("email:0:16")
    else:
        assert listed == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail jane at example.de now", "email:5:23"),
        ("mail jane @ example.fr, please", "email:5:22"),
        ("jane @ mail.example.co.uk", "email:0:25"),
        ("ana arroba ejemplo.es", "email:0:21"),
        ("host 192 dot 168 dot one dot one up", "ip:5:32"),
        ("host 10.0.0.one up", "ip:5:15"),
        ("ip 192 dot 168 dot 1 dot one or", "ip:3:28"),
        ("call +1 551 555 08 two six", "phone:5:18,phone:5:26"),
        ("jane @ example.museum", "email:0:21"),
        ("we met at work.It was late", ""),
        ("4111 1111 1111 111 one", "card:0:22"),
        ("one or two of the 3 at home. Three, 4", ""),
        ("he looked at it.Then he left", ""),
    ],
)
def test_disguised_national_domains_and_mixed_digits(text, found):
    plain = pii.plain_spans(text)
    assert pii.listed(sorted(plain + pii.disguised_spans(text, plain))) == found


def test_pii_rows_and_mask(spark):
    rows = [(1, "a@b.cd and +1 (551) 555-0826"), (1, "a@b.cd and +1 (551) 555-0826"), (2, "x at y dot org")]
    docs = frame(spark, rows + ODD)
    got = pii.find(docs).collect()
    assert len(got) == docs.count()
    first = [r for r in got if r["doc_id"] == 1]
    assert len(first) == 2 and first[0]["n_email"] == 1 and first[0]["n_phone"] == 1
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert masked[1] == "[EMAIL] and [PHONE]" and masked[2] == "[EMAIL]" and masked[1000] is None
    assert pii.mask(docs).columns == docs.columns and pii.find(docs.limit(0)).count() == 0


def test_language_scores_equal_the_kernel_solution_written_out():
    rng = np.random.default_rng(8)
    stems = {"xx": ["ban", "kol", "tir", "sum"], "yy": ["öl", "grü", "kol", "mei"], "zz": ["que", "ban", "oix", "ell"]}
    draw = lambda y: " ".join("".join(rng.choice(stems[y], 2)) for _ in range(6))
    labels = [("xx", "yy", "zz", "xx")[n % 4] for n in range(40)]
    texts, fresh = [draw(y) for y in labels], [draw(y) for y in ("xx", "yy", "zz") * 5]
    sets = lambda group: [set(langid.grams(langid.letter_codes(t)).tolist()) for t in group]
    own, other = sets(texts), sets(fresh)
    kernel = lambda a, b: np.array([[len(s & t) / math.sqrt(len(s) * len(t)) for t in b] for s in a])
    names = sorted(stems)
    y = np.array([[1.0 if label == n else -1.0 for n in names] for label in labels])
    weight = np.array([1.0 / labels.count(label) for label in labels])
    ridge = 0.01 * len(names)
    alpha = np.linalg.solve(weight[:, None] * kernel(own, own) + ridge * np.eye(40), weight[:, None] * y)
    values = np.exp(langid.SHARPNESS * kernel(other, own) @ alpha)
    expected = values.max(axis=1) / values.sum(axis=1)
    got, scores = langid.predict(langid.train(texts, labels, landmarks=40, ridge=0.01), fresh)
    assert got == [names[k] for k in values.argmax(axis=1)]
    assert np.allclose(scores, expected, atol=2e-3)


def test_language_model_gains_over_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in lblm.score(docs, steps=300).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in rows)
    assert len(rows) > 10 and (sum(r["score"] for r in rows) - sum(r["base_score"] for r in rows)) / tokens > 0.02


def test_language_model_gains_more_with_more_hot_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gains = []
    for hot_words in (lblm.OWN, 4000, lblm.HOT_WORDS):
        rows = [r for r in lblm.score(docs, hot_words=hot_words, steps=400).collect() if r["held_out"]]
        gains.append(sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows))
    assert gains[0] < gains[1] < gains[2] and gains[2] > 0.25


def test_neighbours_of_hot_words_are_counted_over_all_texts(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(260)]
    share = 1 / np.arange(1, 261)
    texts = [" ".join(rng.choice(words, int(n), p=share / share.sum())) for n in rng.integers(0, 60, 80)] + ["", None]
    frame_ = frame(spark, list(enumerate(texts))).select(F.col("text").cast("binary").alias("text"))
    vocab = lblm.vocabulary(lblm.word_counts(frame_), len(texts), 150)
    expected: Counter = Counter()
    for text in texts:
        line = [vocab.hot.get(w, -1) for w in lblm.tokens((text or "").encode())]
        for i, a in enumerate(line):
            for j in range(max(0, i - lblm.REACH), min(len(line), i + lblm.REACH + 1)):
                if i != j and a >= 0 and 0 <= line[j] < lblm.PILLARS:
                    expected[a, line[j]] += 1
    got = {}
    for row in lblm.neighbour_counts(frame_.repartition(3), vocab).collect():
        got.update({(row["word"], n): row[f"p{n}"] for n in range(lblm.PILLARS) if row[f"p{n}"]})
    assert len(vocab.hot) > lblm.PILLARS and got == expected


def test_words_with_the_same_neighbours_are_grouped():
    rng = np.random.default_rng(7)
    kinds = rng.integers(0, 3, 200)
    shares = np.array([[8, 1, 1, 1], [1, 8, 1, 1], [1, 1, 8, 1]]) / 11
    table = np.stack([rng.multinomial(60, shares[k]) for k in kinds])
    table[::50] = 0
    got = lblm.group_words(table, 4)
    assert (got[::50] == 3).all()
    filled = table.any(axis=1)
    assert len({(a, b) for a, b in zip(got[filled].tolist(), kinds[filled].tolist(), strict=True)}) == 3
    assert (lblm.group_words(np.zeros((5, 4), dtype=np.int64), 4) == 3).all()
    assert lblm.group_words(table[:0], 4).shape == (0,)


def test_language_model_scores(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    rows = [(i, " ".join(rng.choice(words, 30, p=share / share.sum()))) for i in range(200)]
    docs = frame(spark, rows + ODD)
    got = {(r["doc_id"], r["n_tokens"]): r for r in lblm.score(docs, hot_words=150, steps=60).collect()}
    assert len(got) == docs.count()
    split = re.compile(r"[^\x20\x09-\x0D]+").findall
    training = [t or "" for i, t in rows + ODD if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in training for w in split(t))
    n, v = sum(count.values()) + len(training), len(count) + 1
    for i, t in rows + ODD:
        own = split(t or "")
        r = got[i, len(own) + 1]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(training) + 1) / (n + v + 1))
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == n
        assert r["n_known"] == sum(count[w] > 0 for w in own) + 1 and r["score"] < 0
    assert lblm.score(docs.limit(0), steps=5).count() == 0


def test_language_model_is_normalised():
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, lblm.CLASSES * (lblm.CLASSES + 1) ** 2, 500))
    model = lblm.train(codes, rng.integers(1, 9, len(codes)), steps=20)
    logs = model.log_probabilities(np.arange((lblm.CLASSES + 1) ** 2))
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-4)
    classes = np.append(np.arange(200) % 50 + 40, lblm.CLASSES - 1)
    many = lblm.Vocabulary({}, np.arange(200)[::-1] + 1, 0, 0, 0, 0, 0, 0, classes)
    inside = np.bincount(classes[:-1], weights=10 ** many.shares()[:-1], minlength=lblm.CLASSES)
    assert np.allclose(inside[inside > 0], 1) and many.shares()[-1] == 0
