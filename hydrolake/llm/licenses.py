"""License scan with a positional index of rare words.

Words are maximal runs of a-z (A-Z in lower case), digits and characters beyond
ASCII. A template is a phrase, whose words must stand consecutively, or a
notice, a longer text that may be reflowed, marked as a comment or have other
words in between.

Method. The document frequency of every word of the templates is counted over the
whole corpus. The index has postings (template, position) of the words of highest
IDF only: the rarest word of each phrase, the ``KEYS`` rarest words of each notice. A file
looks up every occurrence of these words. For a phrase, the place that a hit implies is
intersected with the postings of the other words at their relative positions, so
every place is found: each holds the phrase's rarest word. For a notice,
hits whose relative positions (place in the file less place in the template)
differ by at most ``SLACK`` from one to the next are one candidate; it needs half of the
notice's keys, then all mandatory key phrases inside its window (``SLACK`` words wider
on both sides than the hits imply), and then ``COVERED`` of the notice's words there,
weighted by IDF. The score of a place is that coverage,
1 for a phrase.

Null and empty texts have no words and no place. Repeated rows are scanned each; ties in
IDF go to the earlier word of the template. An empty table gives an empty table.
Every word of every text is looked up, however long the text. Columns of the input
named like a result are replaced; others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake.llm.tokens import encoded, slices
from hydrolake.llm.words import ALPHANUMERIC, Words, cut

#: Rare words of a notice that are indexed, words that may stand between two hits, and the share of a notice that must be there.
KEYS, SLACK, COVERED = 8, 16, 0.75

PLACE = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("base", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Phrase:
    """Words that stand consecutively; ``base`` ones are those that a scan must report by contract."""

    label: str
    text: str
    base: bool = False


@dataclass(frozen=True)
class Notice:
    """A longer text and the phrases of it that must stand in its window."""

    label: str
    text: str
    mandatory: tuple[str, ...]


# Phrases and license notices as they are in common use.
PHRASES = (
    Phrase("gpl", "gnu general public license", True),
    Phrase("apache", "apache license", True),
    Phrase("cc-by", "cc by", True),
    Phrase("mit", "mit license", True),
    Phrase("gpl-2.0", "gnu general public license version 2"),
    Phrase("gpl-3.0", "gnu general public license version 3"),
    Phrase("lgpl", "gnu lesser general public license"),
    Phrase("agpl", "gnu affero general public license"),
    Phrase("apache-2.0", "apache license version 2 0"),
    Phrase("mpl-2.0", "mozilla public license version 2 0"),
    Phrase("mpl-2.0", "mozilla public license v 2 0"),
    Phrase("epl-2.0", "eclipse public license 2 0"),
    Phrase("bsl-1.0", "boost software license version 1 0"),
    Phrase("bsd-2-clause", "bsd 2 clause license"),
    Phrase("bsd-3-clause", "bsd 3 clause license"),
    Phrase("isc", "isc license"),
    Phrase("cc0-1.0", "cc0 1 0"),
    Phrase("cc-by-4.0", "cc by 4 0"),
    Phrase("cc-by-sa-4.0", "cc by sa 4 0"),
    Phrase("cc-by-nc-4.0", "cc by nc 4 0"),
    Phrase("cc-by-nd-4.0", "cc by nd 4 0"),
    Phrase("cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    Phrase("cc-by", "creative commons attribution"),
)
NOTICES = (
    Notice(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted free of charge", "this permission notice shall be included in all copies"),
    ),
    Notice(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    Notice(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted", "appear in all copies"),
    ),
    Notice(
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        'by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" '
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Notice(
        "gpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
        ("gnu general public license", "version 3 of the license", "any later version"),
    ),
    Notice(
        "gpl-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
        ("gnu general public license", "version 2 of the license", "any later version"),
    ),
    Notice(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("subject to the terms of the mozilla public license", "v 2 0"),
    ),
    Notice(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software.",
        ("in no event will the authors be held liable", "the origin of this software must not be misrepresented"),
    ),
    Notice(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
)


def words_of(text: str) -> list[bytes]:
    return cut([text.encode()], ALPHANUMERIC, lower=True).array.to_pylist()


@dataclass
class Index:
    """Templates as word numbers, and the places of their rarest words."""

    vocabulary: list[bytes]
    idf: np.ndarray
    phrases: list[tuple[Phrase, np.ndarray, int]]
    notices: list[tuple[Notice, np.ndarray, list[np.ndarray]]]
    #: (word, notice, position) of the keys, by word, and how many of a notice's keys a candidate needs.
    postings: np.ndarray
    need: np.ndarray


def vocabulary_of(phrases: Iterable[Phrase], notices: Iterable[Notice]) -> list[bytes]:
    return sorted({w for t in (*phrases, *notices) for w in words_of(t.text)} | {w for t in notices for m in t.mandatory for w in words_of(m)})


def build(frequencies: dict[bytes, int], n_docs: int, phrases: Iterable[Phrase] = PHRASES, notices: Iterable[Notice] = NOTICES, keys: int = KEYS) -> Index:
    """The index, given in how many of ``n_docs`` texts each word stands."""
    phrases, notices = tuple(phrases), tuple(notices)
    vocabulary = vocabulary_of(phrases, notices)
    place = {w: i for i, w in enumerate(vocabulary)}
    idf = np.array([math.log((n_docs + 1) / (frequencies.get(w, 0) + 0.5)) for w in vocabulary])
    numbers = lambda text: np.array([place[w] for w in words_of(text)])
    first, second, postings, need = [], [], [], []
    for p in phrases:
        ids = numbers(p.text)
        first.append((p, ids, int(np.argmax(idf[ids]))))
    for number, t in enumerate(notices):
        ids = numbers(t.text)
        different = list(dict.fromkeys(ids.tolist()))
        rare = sorted(different, key=lambda i: -idf[i])[:keys]
        postings += [(int(i), number, at) for at, i in enumerate(ids) if i in set(rare)]
        need.append(-(-len(rare) // 2))
        second.append((t, ids, [numbers(m) for m in t.mandatory]))
    return Index(vocabulary, idf, first, second, np.array(sorted(postings), np.int64).reshape(-1, 3), np.array(need, np.int64))


def places_of(ids: np.ndarray, what: np.ndarray, anchor: int = 0) -> np.ndarray:
    """Where the words ``what`` stand consecutively in ``ids``, by way of the hits of the one at ``anchor``."""
    at = np.flatnonzero(ids == what[anchor]) - anchor
    at = at[(at >= 0) & (at + len(what) <= len(ids))]
    for j, w in enumerate(what):
        at = at[ids[at + j] == w]
    return at


def find_phrases(ids: np.ndarray, firsts: np.ndarray, index: Index) -> Iterator[tuple[int, int, Phrase]]:
    """(text, word number in it, phrase) of every place of every phrase."""
    for p, what, anchor in index.phrases:
        at = places_of(ids, what, anchor)
        doc = np.searchsorted(firsts, at, "right") - 1
        inside = at + len(what) <= firsts[doc + 1]
        yield from ((d, a, p) for d, a in zip(doc[inside].tolist(), (at - firsts[doc])[inside].tolist()))


def find_notices(ids: np.ndarray, firsts: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, Notice, float]]:
    """(text, first word, words, notice, coverage) of every notice."""
    if not len(index.postings):
        return
    keys = np.zeros(len(index.vocabulary) + 1, bool)  # the last place is for words that are in no template
    keys[index.postings[:, 0]] = True
    hits = np.flatnonzero(keys[ids])
    begin = np.searchsorted(index.postings[:, 0], ids[hits], "left")
    count = np.searchsorted(index.postings[:, 0], ids[hits], "right") - begin
    entry = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
    at = np.repeat(hits, count)
    word, notice, position = index.postings[entry].T
    doc = np.searchsorted(firsts, at, "right") - 1
    offset = at - firsts[doc] - position
    order = np.lexsort((offset, notice, doc))
    doc, notice, offset, word = doc[order], notice[order], offset[order], word[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (notice[1:] != notice[:-1]) | (offset[1:] - offset[:-1] > SLACK)
    group = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(doc))
    different = np.bincount(np.unique(group * len(index.vocabulary) + word) // len(index.vocabulary), minlength=len(begins)) if len(doc) else np.zeros(0, int)
    for g in np.flatnonzero(different >= index.need[notice[begins]]).tolist():
        d, t = int(doc[begins[g]]), int(notice[begins[g]])
        template, what, mandatory = index.notices[t]
        # Words may also have been put in before the first key and after the last.
        low = max(0, int(offset[begins[g]]) - SLACK)
        high = min(int(firsts[d + 1] - firsts[d]), int(offset[ends[g] - 1]) + len(what) + SLACK)
        window = ids[firsts[d] + low : firsts[d] + high]
        own = np.flatnonzero(np.isin(window, what))
        low, window = low + int(own[0]), window[own[0] : own[-1] + 1]
        if not all(len(places_of(window, m)) for m in mandatory):
            continue
        wanted = np.unique(what)
        weight = np.maximum(index.idf[wanted], 0.0)
        there = np.isin(wanted, window)
        covered = float(weight[there].sum() / weight.sum()) if weight.sum() else float(there.mean())
        if covered >= COVERED:
            yield d, low, len(window), template, min(1.0, covered)


def word_numbers(words: Words, vocabulary: pa.Array) -> np.ndarray:
    """Each word's place in the vocabulary, or its length for words that are not in it."""
    return pc.fill_null(pc.index_in(words.array, vocabulary), len(vocabulary)).to_numpy()


def corpus_index(docs: DataFrame, text: str = "text", phrases: Iterable[Phrase] = PHRASES, notices: Iterable[Notice] = NOTICES) -> Index:
    """The index with document frequencies of all texts; a task sends one count per word of the templates."""
    phrases, notices = tuple(phrases), tuple(notices)
    vocabulary = vocabulary_of(phrases, notices)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.binary())
        size = len(vocabulary) + 1
        found = np.zeros(size, np.int64)  # the last one counts texts
        for batch in slices(batches, "text"):
            words = cut(encoded(batch.column("text")), ALPHANUMERIC, lower=True)
            ids = word_numbers(words, known)
            inside = ids < size - 1
            found += np.bincount(np.unique(words.doc[inside] * size + ids[inside]) % size, minlength=size)
            found[-1] += batch.num_rows
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(size)), "found": pa.array(found)})

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word long, found long").groupBy("word").agg(F.sum("found").alias("found"))
    counts = {r["word"]: r["found"] for r in rows.collect()}
    return build({w: counts.get(i, 0) for i, w in enumerate(vocabulary)}, counts.get(len(vocabulary), 0), phrases, notices)


def scan(docs: DataFrame, index: Index, text: str = "text", n_words: str = "n_words", places: str = "places") -> DataFrame:
    """Add the number of words and all places (label, start and length in words, base, score) by start, length, label."""
    from pyspark.sql.pandas.types import to_arrow_schema

    new = {n_words: T.LongType(), places: T.ArrayType(PLACE, False)}
    target = T.StructType([f for f in docs.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in new.items()])
    schema = to_arrow_schema(target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(index.vocabulary, pa.binary())
        for batch in slices(batches, text):
            words = cut(encoded(batch.column(text)), ALPHANUMERIC, lower=True)
            ids = word_numbers(words, known)
            found: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            for d, at, p in find_phrases(ids, words.firsts, index):
                found[d].append((at, len(words_in[p]), p.label, p.base, 1.0))
            for d, at, length, t, covered in find_notices(ids, words.firsts, index):
                found[d].append((at, length, t.label, False, covered))
            rows = [[{"label": n, "start": a, "length": z, "base": b, "score": s} for a, z, n, b, s in sorted(x)] for x in found]
            results = {n_words: pa.array(np.diff(words.firsts).astype(np.int64)), places: pa.array(rows, schema.field(places).type)}
            yield pa.RecordBatch.from_arrays([results[f.name] if f.name in results else batch.column(f.name) for f in schema], schema=schema)

    words_in = {p: what for p, what, _ in index.phrases}
    return docs.mapInArrow(run, target)
