"""Find licences in texts through a positional index of their rarest words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .rows import fields, give_back, quoted, slices, with_arrays
from .words import Words, byte_class, tokenized

# Words are runs of digits, letters and bytes beyond ASCII.
_IN_WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    """A licence notice: its text, and phrases that must stand in it word for word."""

    label: str
    text: str
    key_phrases: tuple[str, ...] = ()


# Phrases that name a licence by themselves.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# The wording of licence notices, and the phrases that set each apart.
TEMPLATES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "without restriction")),
    Template("mit", "Released under the MIT License", ("the mit license",)),
    Template("mit", "Licensed under the MIT licence", ("mit licence",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0",)),
    Template("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ("required by applicable law or agreed to in writing", "without warranties or conditions of any kind")),
    Template("apache-2", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2 0",)),
    Template("mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    Template("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause", ("spdx license identifier bsd 2 clause",)),
    Template("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause", ("spdx license identifier bsd 3 clause",)),
    Template("gpl-2", "SPDX-License-Identifier: GPL-2.0", ("spdx license identifier gpl 2 0",)),
    Template("gpl-3", "SPDX-License-Identifier: GPL-3.0", ("spdx license identifier gpl 3 0",)),
    Template("mpl-2", "SPDX-License-Identifier: MPL-2.0", ("spdx license identifier mpl 2 0",)),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license version 3",)),
    Template("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1", ("gnu lesser general public license version 2 1",)),
    Template("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license version 3",)),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license as published by", "version 3")),
    Template("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license as published by", "version 2")),
    Template("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ("redistribution and use in source and binary forms", "must reproduce the above copyright notice")),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("cc0", "Dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    Template("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ("creative commons attribution noncommercial sharealike",)),
]


def split_words(text: str) -> list[str]:
    """The words of a template or phrase."""
    return _WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


class Vocabulary:
    """Numbers for the words of all templates and phrases; words of a text that are none of them get -1."""

    def __init__(self, words: Sequence[str]):
        self.words = sorted(set(words))
        self.number = {w: i for i, w in enumerate(self.words)}
        own = tokenized(pa.array(self.words, pa.string()), _IN_WORD)
        self.order = np.argsort(own.hashes)
        self.hashes = own.hashes[self.order]
        coded = [w.encode() for w in self.words]
        self.lengths = np.array([len(w) for w in coded], np.int64)
        self.bytes = np.zeros((len(coded), max(map(len, coded), default=0)), np.uint8)
        for i, w in enumerate(coded):
            self.bytes[i, : len(w)] = np.frombuffer(w, np.uint8)

    def numbers(self, text: Words) -> np.ndarray:
        """The number of each word; a hash that matches is compared byte by byte."""
        out = np.full(len(text.hashes), -1, np.int32)
        if not len(self.hashes) or not len(out):
            return out
        at = np.minimum(np.searchsorted(self.hashes, text.hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == text.hashes)
        word = self.order[at[hit]]
        same = text.ends[hit] - text.starts[hit] == self.lengths[word]
        hit, word = hit[same], word[same]
        for k in range(self.bytes.shape[1]):
            inside = k < self.lengths[word]
            equal = text.data[np.minimum(text.starts[hit] + k, len(text.data) - 1)] == self.bytes[word, k]
            keep = equal | ~inside
            hit, word = hit[keep], word[keep]
        out[hit] = word
        return out


@dataclass
class Index:
    """Templates posted under their rarest words, with the place of each there.

    A text that matches a template by a share ``min_share`` of its weight (the inverse
    document frequencies of its words) cannot lack all words of a set that weighs more
    than the rest may. Each template is posted under the rarest words that make up such
    a set, and is looked up by no others; a phrase, which must match as a whole, by its
    rarest word alone. So every match has a word that leads to it.
    """

    vocabulary: Vocabulary
    idf: np.ndarray
    min_share: float
    templates: list[np.ndarray] = field(default_factory=list)
    phrases: list[np.ndarray] = field(default_factory=list)
    keys: list[list[int]] = field(default_factory=list)

    def add_phrase(self, words: Sequence[str]) -> int:
        self.phrases.append(np.array([self.vocabulary.number[w] for w in words]))
        return len(self.phrases) - 1

    def add_template(self, words: Sequence[str], keys: list[int]) -> None:
        self.templates.append(np.array([self.vocabulary.number[w] for w in words]))
        self.keys.append(keys)

    def rarest(self, words: np.ndarray, share: float) -> np.ndarray:
        """Places of the rarest words of a template, one of which every match of that share has."""
        weight = self.idf[words]
        order = np.lexsort((words, -weight))
        left_out = weight.sum() - np.cumsum(weight[order])
        n = int(np.argmax(left_out < share * weight.sum() * (1 - 1e-12))) + 1
        return order[:n]

    def postings(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, list[tuple[int, int]]]]:
        """For each posted word the (phrase, place) and the (template, place) pairs."""
        phrases: dict[int, list[tuple[int, int]]] = {}
        templates: dict[int, list[tuple[int, int]]] = {}
        for p, words in enumerate(self.phrases):
            q = int(self.rarest(words, 1.0)[0])
            phrases.setdefault(int(words[q]), []).append((p, q))
        for t, words in enumerate(self.templates):
            for q in self.rarest(words, self.min_share):
                templates.setdefault(int(words[q]), []).append((t, int(q)))
        return phrases, templates


@dataclass
class Places:
    """Where one phrase or template stands: text, first word there, share of its weight."""

    exact: bool
    number: int
    owner: np.ndarray
    first: np.ndarray
    score: np.ndarray


class Scanner:
    """Places of phrases and templates in texts, found through an :class:`Index`."""

    def __init__(self, index: Index, drift: int):
        self.index, self.drift = index, drift
        self.phrase_posts, self.template_posts = index.postings()
        posted = set(self.phrase_posts) | set(self.template_posts)
        self.posted = np.zeros(len(index.idf), bool)
        self.posted[list(posted)] = True
        self.weights = [index.idf[w] for w in index.templates]

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[Places]]:
        """Words per text, and the places of each phrase and template that occurs."""
        words = tokenized(texts, _IN_WORD)
        number = self.index.vocabulary.numbers(words)
        # Places of the index's words, grouped by word: others are not looked at.
        places = np.flatnonzero((number >= 0) & self.posted[number])
        places = places[np.argsort(number[places], kind="stable")]
        found, edges = np.unique(number[places], return_index=True)
        groups = dict(zip(found.tolist(), np.split(places, edges[1:])))
        phrases = self._phrases(words, number, groups)
        out = []
        for p, at in phrases.items():
            if len(at):
                owner = self._owner(words, at)
                out.append(Places(True, p, owner, at - words.at[owner], np.ones(len(at))))
        return np.diff(words.at), out + self._templates(words, number, groups, phrases)

    @staticmethod
    def _owner(words: Words, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(words.at, places, "right") - 1

    def _phrases(self, words: Words, number: np.ndarray, groups: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Starts of each phrase: places of its rarest word, intersected with its other words by relative position."""
        out = {}
        for w, posts in self.phrase_posts.items():
            here = groups.get(w, np.zeros(0, np.int64))
            owner = self._owner(words, here)
            for p, q in posts:
                phrase = self.index.phrases[p]
                at = here - q
                at = at[(at >= words.at[owner]) & (at + len(phrase) <= words.at[owner + 1])]
                for k, other in enumerate(phrase):
                    at = at[number[at + k] == other]
                out[p] = at
        return out

    def _templates(self, words, number, groups, phrases, pairs: int = 1 << 21) -> list[Places]:
        """Alignments whose words match by weight within the drift, and that hold all key phrases."""
        candidates: dict[int, list[np.ndarray]] = {}
        for w, posts in self.template_posts.items():
            at = groups.get(w)
            for t, q in posts if at is not None else ():
                if all(len(phrases[k]) for k in self.index.keys[t]):
                    candidates.setdefault(t, []).append(np.stack([self._owner(words, at), at - q], axis=1))
        out = []
        for t, pairs_ in candidates.items():
            template, weight = self.index.templates[t], self.weights[t]
            owner, start = np.unique(np.concatenate(pairs_), axis=0).T
            low, high = words.at[owner], words.at[owner + 1]
            ok = np.ones(len(start), bool)
            for k in self.index.keys[t]:  # key phrases lie inside the window, whole
                at, size = phrases[k], len(self.index.phrases[k])
                first = np.searchsorted(at, np.maximum(start - self.drift, low))
                last = np.minimum(start + len(template) + self.drift, high)
                ok &= (first < len(at)) & (at[np.minimum(first, len(at) - 1)] + size <= last)
            owner, start, low, high = owner[ok], start[ok], low[ok], high[ok]
            score = np.zeros(len(start))
            span = np.arange(len(template))
            cost = len(start) * len(template) * (2 * self.drift + 1)
            for part in np.array_split(np.arange(len(start)), max(1, cost // pairs)):
                matched = np.zeros((len(part), len(template)), bool)
                for d in range(-self.drift, self.drift + 1):
                    at = start[part, None] + span + d
                    inside = (at >= low[part, None]) & (at < high[part, None])
                    matched |= inside & (number[np.clip(at, 0, len(number) - 1)] == template)
                score[part] = np.minimum(matched @ weight / weight.sum(), 1.0)
            good = score >= self.index.min_share
            owner, start, low, score = owner[good], start[good], low[good], score[good]
            if not len(start):
                continue
            # One alignment per place: the best of those that the drift does not part.
            new = np.ones(len(start), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (np.diff(start) > self.drift)
            cluster = np.cumsum(new)
            order = np.lexsort((start, -score, cluster))
            best = order[np.unique(cluster[order], return_index=True)[1]]
            out.append(Places(False, t, owner[best], np.maximum(start[best] - low[best], 0), score[best]))
        return out


def document_frequencies(texts: DataFrame, vocabulary: Vocabulary, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each word of the vocabulary occurs, and how many texts there are. Counts all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary.words), np.int64), 0
        for batch in batches:
            for part in slices(batch, 4 << 20):
                words = tokenized(part.column(0), _IN_WORD)
                number = vocabulary.numbers(words).astype(np.int64)
                at = np.flatnonzero(number >= 0)
                owner = np.searchsorted(words.at, at, "right") - 1
                seen = np.unique(owner * len(vocabulary.words) + number[at])
                total += np.bincount(seen % len(vocabulary.words), minlength=len(total))
                n += part.num_rows
        ids = np.concatenate([np.flatnonzero(total), [-1]])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([total[total > 0], [n]]))], names=["word", "n"])
        give_back()

    counts = texts.select(F.col(quoted(text_col))).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}  # one row per word of the templates
    return np.array([found.get(i, 0) for i in range(len(vocabulary.words))], np.int64), found.get(-1, 0)


def find(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[Template] = TEMPLATES,
    min_share: float = 0.75,
    drift: int = 4,
    text_col: str = "text",
) -> DataFrame:
    """Licences named or quoted in each text, with the places.

    Returns the columns of ``docs`` and ``n_words`` and ``found``, the places in order:
    ``label``, ``first_word`` (from 0), ``n_words`` (of the phrase or template),
    ``score``, ``exact`` (a phrase, whose words stand there one after another).
    Columns of these two names are replaced. Words are runs of letters, digits and
    characters beyond ASCII, with A-Z lowered.

    One pass counts in how many texts each word of the templates occurs. The rarest
    words of each template, by inverse document frequency, are its entries in a
    positional index. A second pass looks the words of each text up there, rarest words
    only, and intersects postings by relative position: a phrase needs all its words at
    their places; a template needs words with ``min_share`` of its weight, each at most
    ``drift`` words off, and its key phrases word for word. ``score`` is that share, 1
    for a phrase. The index has the size of the templates, not of the corpus.

    A missing or empty text has no words and no places; repeated rows are each scanned;
    an empty table stays empty. Texts of any length are scanned whole, a task holds some
    thirty bytes for each of the longest text. Alignments that the drift does not part
    count once, the best of them (of equals the first).
    """
    split = [split_words(p) for _, p in phrases]
    whole = [split_words(t.text) for t in templates]
    keys = [[split_words(k) for k in t.key_phrases] for t in templates]
    vocabulary = Vocabulary([w for words in [*split, *whole, *[k for ks in keys for k in ks]] for w in words])
    n_in, n = document_frequencies(docs, vocabulary, text_col)
    index = Index(vocabulary, np.array([math.log(1 + n / (1 + c)) + 1e-9 for c in n_in]), min_share)
    numbers: dict[tuple[str, ...], int] = {}
    for words in split:
        numbers[tuple(words)] = index.add_phrase(words)
    for words, own in zip(whole, keys):
        for key in own:
            if tuple(key) not in numbers:
                numbers[tuple(key)] = index.add_phrase(key)
        index.add_template(words, [numbers[tuple(key)] for key in own])
    # Labels of the phrases asked for; those that are only keys of templates have none.
    labels: dict[int, list[str]] = {}
    for (label, _), words in zip(phrases, split):
        labels.setdefault(numbers[tuple(words)], []).append(label)
    names = sorted({*[label for label, _ in phrases], *[t.label for t in templates]})
    added = fields("n_words long, found array<struct<label: string, first_word: long, n_words: int, score: double, exact: boolean>>")
    kind = to_arrow_type(added["found"].dataType)

    def scan():
        scanner = Scanner(index, drift)

        def f(texts: pa.Array) -> list:
            n_words, places = scanner.scan(texts)
            columns = []
            for p in places:
                own, sizes = ([templates[p.number].label], index.templates) if not p.exact else (labels.get(p.number, []), index.phrases)
                for label in own:
                    n = len(p.owner)
                    fixed = [np.full(n, names.index(label)), np.full(n, len(sizes[p.number])), np.full(n, p.exact)]
                    columns.append([p.owner, p.first, p.score, *fixed])
            owner, first, score, label, size, exact = [np.concatenate(c) for c in zip(*columns)] if columns else [np.zeros(0, np.int64)] * 6
            order = np.lexsort((-score, ~exact.astype(bool), label, first, owner))
            struct = pa.StructArray.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(label[order])), pa.array(first[order], pa.int64()), pa.array(size[order], pa.int32()),
                 pa.array(score[order], pa.float64()), pa.array(exact[order].astype(bool))],
                fields=list(kind.value_type),
            )
            edges = np.searchsorted(owner[order], np.arange(len(texts) + 1)).astype(np.int32)
            return [pa.array(n_words), pa.ListArray.from_arrays(pa.array(edges), struct)]

        return f

    return with_arrays(docs, [text_col], added, scan)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per text of :func:`find`: how often and where phrases stand, the labels, and the best score.

    ``labels`` has those of phrases and templates, ``base_labels`` those of phrases;
    both are distinct, sorted and joined by commas, empty where there is none.
    """
    exact = F.filter("found", lambda x: x["exact"])
    starts = F.transform(exact, lambda x: x["first_word"])

    def names(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")

    return found.select(
        F.col(quoted(id_col)), F.col("n_words"), F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(exact).alias("base_labels"), names(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )
