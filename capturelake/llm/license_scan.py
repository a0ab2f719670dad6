"""Licence scans: matching statistics of texts against a generalised suffix automaton of licence tokens.

A null text is empty: no words, no place, score 0. Repeated rows are scanned
each; other columns are not read; an empty table gives an empty one. Texts are
streamed whole; only runs of words whose neighbours also stand together in
some template enter the automaton, as shorter matches count for nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .arrow import map_texts

#: Shortest match that a chain uses, most text words between two of its matches, and the least covered share of a template.
LEAST_MATCH, MOST_GAP, LEAST_COVER = 3, 40, 0.7

# Phrases and their labels.
PHRASES: Mapping[str, str] = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Passages of public licence notices, by label.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
                   " either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
            " following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
            " disclaimer"),
    ("cc-by-4.0", "licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "CC BY 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under the Creative Commons Attribution ShareAlike"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this"
                " work"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
            " granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            " documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
            " Software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: A-Z become a-z; digits, a-z and all bytes beyond ASCII stay; anything else parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several token sequences; sequence n is ``texts[n]``."""

    def __init__(self, texts: Iterable[Sequence[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.texts = [list(t) for t in texts]
        self.ends: list[int] = []  # state of each whole sequence
        for t in self.texts:
            last = 0
            for c in t:
                last = self._extend(last, c)
            self.ends.append(last)

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        return len(self.next) - 1

    def _part(self, p: int, c: int) -> int:
        """The state of p's longest string plus c, parted from longer strings where it shares their state."""
        q = self.next[p][c]
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._part(last, c)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._part(p, c)
        return new

    def shorter(self, state: int) -> Iterable[int]:
        """The state and those of its shorter suffixes, without the empty one."""
        while state > 0:
            yield state
            state = self.link[state]

    def places(self, least: int) -> dict[int, list[tuple[int, int]]]:
        """(sequence, end) of each occurrence of each state's strings of ``least`` or more tokens."""
        out: dict[int, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.texts):
            state = 0
            for i, c in enumerate(t):
                state = self.next[state][c]
                for s in self.shorter(state):
                    if self.size[s] < least:
                        break
                    out.setdefault(s, []).append((n, i + 1))
        return out

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """State and length of the longest suffix of the text read so far that some sequence holds."""
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.size[state]
        if c in self.next[state]:
            return self.next[state][c], size + 1
        return 0, 0


class Match(NamedTuple):
    """Tokens of a template (from, to) that stand in the text at ``at``."""

    template: int
    start: int
    end: int
    at: int


class Scanner:
    """The templates and phrases of one scan."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Mapping[str, str]) -> None:
        self.labels = [label for label, _ in templates] + list(phrases.values())
        texts = [tokens(t.encode()) for t in [*(t for _, t in templates), *phrases]]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        coded = [[self.vocabulary[w] for w in t] for t in texts]
        self.templates = len(templates)
        self.sizes = [len(t) for t in coded]
        self.automaton = Automaton(coded)
        self.places = self.automaton.places(LEAST_MATCH)
        self.pairs = np.zeros((len(self.vocabulary) + 1,) * 2, bool)
        for t in coded:
            self.pairs[t[:-1], t[1:]] = True
        ends = {state: n for n, state in enumerate(self.automaton.ends) if n >= self.templates}
        # A phrase was put in as a sequence of its own, so it is the longest string of its state.
        self.phrases = [[ends[s] for s in self.automaton.shorter(state) if s in ends]
                        for state in range(len(self.automaton.next))]

    def scan(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], list[Match]]:
        """Places (start, phrase) of whole phrases, and the longest matches at each end."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        paired = np.flatnonzero(self.pairs[ids[:-1], ids[1:]])  # -1 is the empty last row and column
        found: list[tuple[int, int]] = []
        matches: list[Match] = []
        if not len(paired):
            return found, matches
        for run in np.split(paired, np.flatnonzero(np.diff(paired) > 1) + 1):
            first, last = int(run[0]), int(run[-1]) + 1
            state = size = 0
            for at, c in enumerate(ids[first:last + 1].tolist(), first):
                was, length = state, size
                state, size = self.automaton.step(state, size, c)
                if size <= length:
                    self._note(matches, was, length, at)
                for n in self.phrases[state]:
                    if self.sizes[n] <= size:
                        found.append((at + 1 - self.sizes[n], n))
            self._note(matches, state, size, last + 1)
        return found, matches

    def _note(self, matches: list[Match], state: int, size: int, end: int) -> None:
        if size >= LEAST_MATCH:
            matches += [Match(n, e - size, e, end - size) for n, e in self.places[state] if n < self.templates]

    def chains(self, matches: Sequence[Match]) -> list[tuple[int, int, int, float]]:
        """Best chain of each template: (template, first word, word after the last, covered share)."""
        out = []
        for n in sorted({m.template for m in matches}):
            own = sorted((m for m in matches if m.template == n), key=lambda m: (m.at, m.start))
            best: list[tuple[int, int]] = []  # covered tokens and first word of the best chain that ends here
            top = (0, 0, 0)
            low = 0
            for i, m in enumerate(own):
                while m.at - (own[low].at + own[low].end - own[low].start) > MOST_GAP:
                    low += 1
                covered, first = 0, m.at
                for j in range(low, i):
                    e = own[j]
                    if e.at + e.end - e.start <= m.at and e.end <= m.start and best[j][0] > covered:
                        covered, first = best[j]
                best.append((covered + m.end - m.start, first))
                top = max(top, (best[-1][0], -first, m.at + m.end - m.start))
            out.append((n, -top[1], top[2], top[0] / self.sizes[n]))
        return out


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates, dict(phrases))


_SPAN = StructType([StructField("label", StringType()), StructField("first_word", LongType()),
                    StructField("last_word", LongType()), StructField("covered", DoubleType())])
_ARROW_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())])
_PLACE = StructType([StructField("label", StringType()), StructField("word", LongType())])
_ARROW_PLACE = pa.struct([("label", pa.string()), ("word", pa.int64())])


def scan_licenses(df: DataFrame, keep: list[str], text: str = "text",
                  templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """The ``keep`` columns, the number of words, places of the phrases and the best chain of each template met.

    ``places`` has every place of every phrase (label and first word, from 0);
    ``spans`` has label, first and last word and the covered share (0 to 1).
    """
    given, said = tuple(map(tuple, templates)), tuple(phrases.items())

    def make(texts: list[bytes | None]) -> list[pa.Array]:
        scanner = _scanner(given, said)
        counts, places, spans = [], [], []
        for t in texts:
            words = tokens(t or b"")
            found, matches = scanner.scan(words)
            counts.append(len(words))
            places.append([{"label": scanner.labels[n], "word": at} for at, n in found])
            spans.append([{"label": scanner.labels[n], "first_word": a, "last_word": b - 1, "covered": share}
                          for n, a, b, share in scanner.chains(matches)])
        return [pa.array(counts, pa.int64()), pa.array(places, pa.list_(_ARROW_PLACE)), pa.array(spans, pa.list_(_ARROW_SPAN))]

    return map_texts(df, text, keep, [
        StructField("n_words", LongType()), StructField("places", ArrayType(_PLACE)), StructField("spans", ArrayType(_SPAN))], make)


def license_labels(scanned: DataFrame, keep: list[str], least_cover: float = LEAST_COVER) -> DataFrame:
    """One digest row per scanned row: counts and places of the phrases, labels, and the best covered share."""
    base = F.col("places.label")
    wide = F.filter("spans", lambda s: s["covered"] >= least_cover)
    named = F.array_sort(F.array_distinct(F.concat(base, F.transform(wide, lambda s: s["label"]))))
    return scanned.select(
        *[F.col(f"`{c}`") for c in keep], "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(named, ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("spans.covered"), F.lit(0.0)),
                   F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
