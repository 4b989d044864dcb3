"""Operator 6: licence labels by phrases and by an exact set-similarity join.

Phrases are places where given words stand consecutively.  The join finds every
block of a text that holds at least ``threshold`` of the distinct words of
a template.  The blocks are all windows of ``SPREAD`` times as many words as the
template has, across line breaks, so a notice may be wrapped and words that are
scattered over a longer text are none.  Words are ordered by their frequency over all documents, rarest
first.  To hold o of a template's n words, a block must have one of the template's
n - o + 1 rarest words (prefix filter) and at least o words (length filter),
and at any shared word the words after it on both sides must still suffice
(position filter).  What passes is counted exactly, so the filters only save work.

The templates are a parameter and small; the texts are read twice, once for the
frequencies of the templates' words and once for the join, and never shuffled.

Defined results: a null text is empty, with no words and no labels; an empty
template is never found; equal rows give equal results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, utf8

THRESHOLD = 0.9
SPREAD = 1.25  # words of a block to words of the template

# Labels of phrases, and notices as the licences themselves word them.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-work-notice": "This work is licensed under the GNU General Public License, version 3",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-release": "Released under the MIT License.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense-notice": "This is free and unencumbered software released into the public domain",
}

#: Bytes that are no part of words become blanks, A-Z become a-z.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Index:
    """Templates in the global word order, which of them each prefix word may start, and the words of their blocks."""

    rank: dict[bytes, int]
    templates: dict[str, tuple[bytes, ...]]
    needed: dict[str, int]
    prefix: dict[bytes, tuple[tuple[str, int], ...]]
    span: dict[str, int] = field(default_factory=dict)


def build_index(templates: dict[str, str], frequency: dict[bytes, int], threshold: float) -> Index:
    sets = {label: set(words_of(text.encode())) for label, text in templates.items()}
    order = sorted(set().union(*sets.values()), key=lambda w: (frequency.get(w, 0), w)) if sets else []
    rank = {w: i for i, w in enumerate(order)}
    ordered = {label: tuple(sorted(words, key=rank.__getitem__)) for label, words in sets.items() if words}
    # the least number of words that meets the threshold, safe against rounding
    needed = {label: max(1, math.ceil(threshold * len(words) - 1e-9)) for label, words in ordered.items()}
    prefix: dict[bytes, list[tuple[str, int]]] = {}
    for label, words in ordered.items():
        for i, word in enumerate(words[: len(words) - needed[label] + 1]):
            prefix.setdefault(word, []).append((label, i))
    span = {label: math.ceil(SPREAD * len(words_of(text.encode()))) for label, text in templates.items()}
    return Index(rank, ordered, needed, {w: tuple(found) for w, found in prefix.items()}, span)


def matches(block: set[bytes], index: Index) -> dict[str, float]:
    """Containment by label of the templates that the block meets."""
    known = sorted(block & index.rank.keys(), key=index.rank.__getitem__)
    found: dict[str, float] = {}
    tried: set[str] = set()
    for j, word in enumerate(known):
        for label, i in index.prefix.get(word, ()):
            template, needed = index.templates[label], index.needed[label]
            # the first shared word decides: those before it are not shared
            if label in tried or len(block) < needed or min(len(template) - i, len(known) - j) < needed:
                tried.add(label)
                continue
            tried.add(label)
            shared = sum(w in block for w in template)
            if shared >= needed:
                found[label] = shared / len(template)
    return found


def window_matches(words: list[bytes], index: Index) -> dict[str, float]:
    """Largest containment by label of the templates that a window of the text meets.

    Only windows with a prefix word are looked at: places that are close to each
    other are one stretch, which is filtered as a block before windows slide over it.
    """
    places: dict[str, list[int]] = {}
    for at, word in enumerate(words):
        for label, _ in index.prefix.get(word, ()):
            places.setdefault(label, []).append(at)
    found: dict[str, float] = {}
    for label, at in places.items():
        template, needed, span = index.templates[label], index.needed[label], index.span[label]
        mine, first = set(template), 0
        for i in range(1, len(at) + 1):
            if i < len(at) and at[i] - at[i - 1] < span:
                continue
            start, end = max(0, at[first] - span + 1), at[i - 1] + span
            first = i
            if label not in matches(set(words[start:end]), index):
                continue
            hits = [k for k in range(start, min(end, len(words))) if words[k] in mine]
            inside: dict[bytes, int] = {}
            left = best = 0
            for k in hits:
                inside[words[k]] = inside.get(words[k], 0) + 1
                while hits[left] <= k - span:
                    old = words[hits[left]]
                    inside[old] -= 1
                    if not inside[old]:
                        del inside[old]
                    left += 1
                best = max(best, len(inside))
            if best >= needed:
                found[label] = max(found.get(label, 0.0), best / len(template))
    return found


def phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> tuple[list[int], set[str]]:
    """Starts of all phrases, in words from 0, and their labels."""
    line = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in phrases.items():
        if b" " + phrase + b" " not in line:
            continue
        labels.add(label)
        for place in re.finditer(b"(?= " + re.escape(phrase) + b" )", line):
            starts.append(line.count(b" ", 0, place.start()))
    return starts, labels


def _document_frequency(vocabulary: frozenset[bytes]):
    def count(batches):
        found = dict.fromkeys(sorted(vocabulary), 0)
        for batch in batches:
            for data in batch.column(0):
                for word in vocabulary.intersection(words_of(data.as_py())):
                    found[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return count


def word_frequencies(texts: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Documents with each word of the templates, over the binary column ``data`` of all rows."""
    counted = texts.select("data").mapInArrow(_document_frequency(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(row["word"]): row["n"] for row in counted.collect()}


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the largest containment among the templates found, 0 without any.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("data"))
    vocabulary = frozenset(w for text in templates.values() for w in words_of(text.encode()))
    index = build_index(templates, word_frequencies(rows, vocabulary), threshold)
    encoded = {" ".join(p.split()).encode(): label for p, label in phrases.items()}

    @F.arrow_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            data = x.as_py() or b""
            words = words_of(data)
            starts, base = phrase_places(words, encoded)
            found = {} if index.prefix.keys().isdisjoint(words) else window_matches(words, index)
            out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), max(found.values(), default=0.0)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return rows.select("doc_id", of("data").alias("found")).select("doc_id", "found.*")


def _sql() -> str:
    """SQL twin: every line against every template, without filters; the same where notices stand on short lines of their own."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    templates = ", ".join(f"('{label}', {[w.decode() for w in sorted(set(words_of(text.encode())))]})" for label, text in TEMPLATES.items())
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(words)), lambda i: {' AND '.join(f'words[i + {k}] = {chr(39)}{w}{chr(39)}' for k, w in enumerate(phrase.split(), 1))})) AS spot FROM d"
        for phrase, label in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT doc_id, {lower} AS low, regexp_extract_all({lower}, {word}) AS words FROM documents),
t(label, needed) AS (VALUES {templates}),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(low, chr(10))), {word})) AS words FROM d),
shared AS (SELECT doc_id, label, max(len(list_intersect(words, needed)) / len(needed)) AS share FROM blocks, t GROUP BY ALL),
hits AS (SELECT * FROM shared WHERE share >= {THRESHOLD} - 1e-9),
places AS ({places}),
based AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM hits) GROUP BY 1),
best AS (SELECT doc_id, max(share) AS score FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN based USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""


SQL = _sql()
