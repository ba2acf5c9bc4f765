"""Licence scan with a generalised suffix automaton over words.

All licence templates go into one suffix automaton.  A text is streamed through
it once: the state after each word is the longest suffix that occurs in any
template (the matching statistics).  Long maximal matches are chained, template
by template, into covered spans; the share of a template that its best chain
covers is the evidence for its label.  Short fixed phrases are templates too:
the states whose strings end with one report each of its places.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from medspark.llm.texts import map_texts

_WORD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
              for c in range(256))

# Phrases whose every place counts, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Wording of public licences.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
               "in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
            "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
MIN_MATCH = 4  # words of a match that may join a chain
MAX_GAP = 16  # words of a text between two links of a chain
MIN_COVER = 0.6  # share of a template that gives its label


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all non-ASCII bytes."""
    return text.translate(_WORD).split()


class SuffixAutomaton:
    """All substrings of several word sequences; state 0 is the empty string."""

    def __init__(self, sequences: list[list[bytes]]):
        self.arcs: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]  # first end in each sequence
        for number, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence, 1):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, end)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.ends[self.link[state]]
            for number, end in self.ends[state].items():
                up[number] = min(end, up.get(number, end))

    def _state(self, arcs: dict, link: int, length: int) -> int:
        self.arcs.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """``target`` reached from ``state`` by ``word``, at length one more."""
        if self.length[state] + 1 == self.length[target]:
            return target
        part = self._state(dict(self.arcs[target]), self.link[target], self.length[state] + 1)
        self.link[target] = part
        while state >= 0 and self.arcs[state].get(word) == target:
            self.arcs[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.arcs[last]:  # known from an earlier sequence
            return self._split(last, word, self.arcs[last][word])
        new = self._state({}, 0, self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.arcs[state]:
            self.arcs[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.arcs[state][word])
        return new

    def find(self, sequence: list[bytes]) -> int:
        state = 0
        for word in sequence:
            state = self.arcs[state][word]
        return state


@dataclass
class Span:
    """A chain: covered words of a template and the words of the text it spans."""

    covered: int
    first: int
    last: int
    end: int  # in the template


class LicenseScanner:
    def __init__(self, templates=TEMPLATES, phrases=None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP,
                 min_cover: float = MIN_COVER):
        phrases = PHRASES if phrases is None else phrases
        self.labels = [label for label, _ in templates]
        self.sizes = [len(words(text.encode())) for _, text in templates]
        fixed = [words(p.encode()) for p in phrases]
        self.automaton = SuffixAutomaton([words(text.encode()) for _, text in templates] + fixed)
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        at = {self.automaton.find(p): (label, len(p)) for p, label in zip(fixed, phrases.values(), strict=True)}
        self.phrases: list[list[tuple[str, int]]] = []  # those that end each state's longest string
        for state in range(len(self.automaton.link)):
            found, up = [], state
            while up > 0:
                if up in at:
                    found.append(at[up])
                up = self.automaton.link[up]
            self.phrases.append(found)

    def scan(self, sequence: list[bytes]) -> tuple[list[tuple[int, str]], dict[int, Span]]:
        """Places of the phrases, and each template's best chain."""
        arcs, link, longest = self.automaton.arcs, self.automaton.link, self.automaton.length
        places, best, open_ = [], {}, {}
        root, state, length, min_match = arcs[0], 0, 0, self.min_match
        for i, word in enumerate(sequence):
            if state == 0:
                state = root.get(word, 0)
                length = 1 if state else 0
                if not state:
                    continue
            else:
                target = arcs[state].get(word)
                if target is None:
                    if length >= min_match:
                        self._chain(state, i, length, open_, best)
                    while state > 0 and word not in arcs[state]:
                        state = link[state]
                    length = longest[state]
                    target = arcs[state].get(word)
                    if target is None:
                        state = length = 0
                        continue
                state = target
                length += 1
            if self.phrases[state]:
                places += [(i + 1 - n, label) for label, n in self.phrases[state] if n <= length]
        if length >= min_match:
            self._chain(state, len(sequence), length, open_, best)
        return places, best

    def _chain(self, state: int, stop: int, length: int, open_: dict, best: dict) -> None:
        """Add the match ``sequence[stop - length:stop]`` to the chains of the
        templates that hold it."""
        for number, end in self.automaton.ends[state].items():
            if number >= len(self.labels):
                continue
            chain = open_.get(number)
            if chain and stop - length - chain.last <= self.max_gap and end > chain.end:
                chain.covered += min(length, end - chain.end, stop - 1 - chain.last)
                chain.last, chain.end = stop - 1, end
            else:
                chain = open_[number] = Span(length, stop - length, stop - 1, end)
            if number not in best or chain.covered > best[number].covered:
                best[number] = Span(chain.covered, chain.first, chain.last, chain.end)

    def labelled(self, sequence: list[bytes]):
        """Base places, labels with spans, and the best cover of a template."""
        places, best = self.scan(sequence)
        spans, score = {}, 1.0 if places else 0.0
        for number, span in best.items():
            cover = min(1.0, span.covered / self.sizes[number])
            score = max(score, cover)
            if cover >= self.min_cover:
                label = self.labels[number]
                if label not in spans or cover > spans[label][0]:
                    spans[label] = (cover, span.first, span.last)
        return places, spans, score


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                  phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: words, places of the fixed phrases, labels (of the
    phrases; with those of covered templates), score (largest covered share of a
    template, 1 where a phrase stands) and the templates' spans
    ``label:first word:last word``.

    NULL and empty texts: 0 words, no labels (empty strings), NULL places,
    score 0.  Repeated rows and NULL ids each keep their row.
    """
    def make():
        scanner = LicenseScanner(templates, phrases)

        def columns(texts):
            out = [[] for _ in range(8)]
            for text in texts:
                sequence = words(text)
                places, spans, score = scanner.labelled(sequence)
                base = {label for _, label in places}
                row = (len(sequence), len(places), min(places)[0] if places else None,
                       max(places)[0] if places else None, ",".join(sorted(base)),
                       ",".join(sorted(base | set(spans))), score,
                       ",".join(f"{k}:{a}:{b}" for k, (_, a, b) in sorted(spans.items())))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            return [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        return columns

    return map_texts(df, make, "n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                     "base_labels string, labels string, score double, template_spans string", id_col, text_col)
