"""Licence notices in texts by a positional index of their rarest words.

A word's document frequency over the whole corpus decides which words of a template are indexed.
A file looks up the indexed words that it holds, each place of such a word says where the template
would begin, and the places are intersected. Where at least two words agree on a beginning, the
template's mandatory phrases must stand in the words around. Everything is a column expression of
one row: nothing is shuffled but the word frequencies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lower_ascii

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEX_WORDS = 4
SLACK = 3

# Phrases whose every place counts, and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]


TEMPLATES = (
    Template("mit", "released under the mit license", ("the mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template(
        "cc-by-nc",
        "licensed under a creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial",),
    ),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template(
        "cc-by-sa",
        "licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike",),
    ),
    Template("cc0", "creative commons zero 1 0 universal public domain dedication", ("public domain dedication",)),
    Template(
        "gpl-3",
        "licensed under the gnu general public license version 3",
        ("gnu general public license", "version 3"),
    ),
    Template(
        "gpl-2",
        "licensed under the gnu general public license version 2",
        ("gnu general public license", "version 2"),
    ),
    Template("lgpl", "gnu lesser general public license version", ("gnu lesser general public license",)),
    Template("agpl-3", "gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "the following conditions are met"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee "
        "is hereby granted",
        ("permission to use copy modify", "for any purpose with or without fee"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("unencumbered software released into the public domain",),
    ),
    # Standard notices at the head of files.
    *(
        Template(
            label,
            f"gnu {kind} license as published by the free software foundation either version {version} of the license",
            (f"gnu {kind} license as published by the free software foundation", f"version {version} of the license"),
        )
        for label, kind, version in (
            ("gpl-2", "general public", "2"),
            ("gpl-3", "general public", "3"),
            ("lgpl", "library general public", "2"),
            ("lgpl", "lesser general public", "2 1"),
            ("lgpl", "lesser general public", "3"),
            ("agpl-3", "affero general public", "3"),
        )
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in "
        "compliance with the license you may obtain a copy of the license at",
        ("apache license version 2 0", "you may not use this file except in compliance with the license"),
    ),
    Template(
        "bsd",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission",
        ("may be used to endorse or promote products derived from this software",),
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
        "was not distributed with this file you can obtain one at",
        ("mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file"),
    ),
    *(
        Template(label, f"spdx license identifier {name}", (f"spdx license identifier {name}",))
        for label, name in (
            ("mit", "mit"),
            ("apache-2", "apache 2 0"),
            ("gpl-2", "gpl 2 0"),
            ("gpl-3", "gpl 3 0"),
            ("lgpl", "lgpl 2 1"),
            ("lgpl", "lgpl 3 0"),
            ("agpl-3", "agpl 3 0"),
            ("bsd", "bsd 2 clause"),
            ("bsd", "bsd 3 clause"),
            ("mpl-2", "mpl 2 0"),
            ("isc", "isc"),
            ("cc0", "cc0 1 0"),
            ("cc-by-sa", "cc by sa 4 0"),
            ("cc-by-nc", "cc by nc 4 0"),
            ("unlicense", "unlicense"),
        )
    ),
)


def word_text(text: Column) -> Column:
    """The text's words, lower-case A-Z, each followed and the first preceded by one blank."""
    joined = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, " ")
    return F.concat(F.lit(" "), F.trim(joined), F.lit(" "))


def word_array(joined: Column) -> Column:
    return F.split(F.trim(joined), " ")


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def inverse_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> dict[str, float]:
    """IDF of every template word over all documents; the words are those of the templates only."""
    words = sorted({w for t in templates for w in t.text.split()})
    joined = word_text(F.col(text_col))
    present = F.array_intersect(word_array(joined), strings(words))
    found = docs.select(F.explode(present).alias("word")).groupBy("word").count().collect()
    total = docs.count()
    seen = {r["word"]: r["count"] for r in found}
    return {w: math.log((total + 1) / (seen.get(w, 0) + 1)) for w in words}


def index_of(template: Template, idf: dict[str, float], size: int = INDEX_WORDS) -> list[tuple[str, int, float]]:
    """(word, place, weight) of the template's words with the highest IDF that it holds once."""
    words = template.text.split()
    once = [(w, n) for n, w in enumerate(words) if words.count(w) == 1]
    best = sorted(once, key=lambda p: (-idf[p[0]], p[1]))[:size]
    return [(w, n, idf[w] + 1e-9) for w, n in best]


def _places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase stands."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        matches = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            matches = matches & (F.get(words, i + k) == part)
        return matches

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here))


def _aligned(hits: Column, index: list[tuple[str, int, float]], words: Column, template: Template) -> Column:
    """Largest share of the index weight that stands in line at one beginning, phrases verified."""

    def begin_by(word: str, place: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["i"] - place)

    begins = [begin_by(word, place) for word, place, _ in index]
    pairs = [F.array_intersect(begins[a], begins[b]) for a in range(len(begins)) for b in range(a)]
    agreed = F.array_distinct(F.flatten(F.array(*pairs)))
    size, total = len(template.text.split()), sum(w for _, _, w in index)

    def share(begin: Column) -> Column:
        first = F.greatest(begin - SLACK, F.lit(0))
        around = F.concat(F.lit(" "), F.array_join(F.slice(words, first + 1, F.lit(size + 2 * SLACK)), " "), F.lit(" "))
        verified = F.lit(True)
        for phrase in template.mandatory:
            verified = verified & F.contains(around, F.lit(f" {phrase} "))
        weight = F.lit(0.0)
        for b, (_, _, w) in zip(begins, index, strict=True):
            weight = weight + F.when(F.array_contains(b, begin), w).otherwise(0.0)
        return F.when(verified, F.least(weight / total, F.lit(1.0))).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(agreed, share)), F.lit(0.0))


def scan(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``n_base`` counts the places of the fixed phrases, ``first_word`` and ``last_word`` are the
    smallest and largest of them (null without). ``labels`` adds the templates found. ``score`` is
    1 with a fixed phrase, else the largest aligned share of a template's index. Null and empty
    texts have no words. Null ids stay null, repeated rows give a row each, other columns are left
    out, no rows give no rows.
    """
    idf = inverse_frequencies(docs, templates, text_col)
    indexes = [index_of(t, idf) for t in templates]
    rare = sorted({w for index in indexes for w, _, _ in index}, key=lambda w: (-idf[w], w))
    joined = F.col("_joined")
    rows = docs.select(F.col(id_col).alias("doc_id"), word_text(F.col(text_col)).alias("_joined"))
    n_words = F.when(F.trim(joined) == "", 0).otherwise(
        F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) - 1
    )
    rows = rows.withColumn("n_words", n_words.cast("bigint"))
    has_base = F.lit(False)
    for phrase, _ in BASE_PHRASES:
        has_base = has_base | F.contains(joined, F.lit(f" {phrase} "))
    rows = rows.withColumn("_has_base", has_base).withColumn("_words", word_array(joined))
    words = F.col("_words")
    rows = rows.drop("_joined").withColumn("_looked", F.array_intersect(strings(rare), words))
    has_two = F.lit(False)
    for index in indexes:
        has_two = has_two | (F.size(F.array_intersect(F.col("_looked"), strings([w for w, _, _ in index]))) >= 2)
    rows = rows.withColumn("_words", F.when(F.col("_has_base") | has_two, words))
    numbered = F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    hits = F.filter(numbered, lambda h: F.array_contains(F.col("_looked"), h["w"]))
    rows = rows.withColumn("_hits", hits)
    places = F.array(*(F.coalesce(_places(words, p), F.array().cast("array<int>")) for p, _ in BASE_PHRASES))
    shares = F.array(*(_aligned(F.col("_hits"), i, words, t) for i, t in zip(indexes, templates, strict=True)))
    found = words.isNotNull()
    rows = rows.withColumn("_places", F.when(found, places)).withColumn("_shares", F.when(found, shares)).drop("_words", "_hits")
    base = [F.when(F.size(F.get("_places", F.lit(n))) > 0, label) for n, (_, label) in enumerate(BASE_PHRASES)]
    more = [F.when(F.get("_shares", F.lit(n)) > 0, t.label) for n, t in enumerate(templates)]

    def joined_labels(labels: list[Column]) -> Column:
        kept = F.filter(F.array(*labels), lambda x: x.isNotNull())
        return F.array_join(F.array_sort(F.array_distinct(kept)), ",")

    every = F.flatten(F.col("_places"))
    n_base = F.coalesce(F.when(found_places(every), F.size(every)), F.lit(0)).cast("bigint")
    return rows.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        joined_labels(base).alias("base_labels"),
        joined_labels(base + more).alias("labels"),
        F.when(found_places(every), 1.0)
        .otherwise(F.coalesce(F.array_max("_shares"), F.lit(0.0)))
        .alias("score"),
    )


def found_places(every: Column) -> Column:
    return F.coalesce(F.size(every) > 0, F.lit(False))
