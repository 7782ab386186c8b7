"""Finds licences in texts with a generalised suffix automaton of licence templates.

All templates, as sequences of words, go into one suffix automaton of a few thousand
states. Streaming a text through it gives at each word the longest run ending there
that stands in some template (the matching statistics), and the suffix links give the
shorter runs that stand in other places. Where a place's next word is not the text's, the run is a
match that is as long as it can be on both sides. Matches are chained where they
follow each other in the text and in a template, and a chain that covers enough of
its template is a span of that licence. The base phrases are in the automaton too: a
phrase ends at a word if its state is on the suffix links of the word's state and the
run is long enough.

Words are hashed in vectorised passes over the bytes of a batch. Most are in no
template, and most others follow each other in none, so the automaton sees only the
runs of words whose neighbours are neighbours in a template: everywhere else its
statistics are 0 or 1. Rows stand alone: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_atlas.llm import textkit

#: Words of the shortest match, words of text between two matches of a chain, and the share of a template that a chain must cover.
MIN_MATCH, MAX_GAP, MIN_SHARE = 4, 12, 0.75

#: Fixed values of the contract: phrases and their labels.
BASE_PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Public licence notices as their authors word them, and usual short forms.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
_APART = np.ones(256, bool)
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    _APART[ord(_first) : ord(_last) + 1] = False
_APART[128:] = False


def words(text: str | None) -> list[str]:
    """Words of one text, A-Z lower-cased."""
    return _WORD.findall((text or "").translate(_FOLD))


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers (from 1), with what ends in each state."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: By state: (template, end, words at most) of all places where a run of it or its links ends, and (phrase, words) of the base phrases.
    ends: list[list[tuple[int, int, int]]] = field(default_factory=list)
    phrases: list[list[tuple[int, int]]] = field(default_factory=list)

    def _state(self, length: int, ways: dict[int, int], link: int) -> int:
        self.next.append(ways), self.link.append(link), self.length.append(length)
        return len(self.next) - 1

    def _split(self, source: int, word: int, target: int) -> int:
        """The part of ``target`` that is one word longer than ``source``, as a state of its own."""
        if self.length[target] == self.length[source] + 1:
            return target
        twin = self._state(self.length[source] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = twin
        while source >= 0 and self.next[source].get(word) == target:
            self.next[source][word] = twin
            source = self.link[source]
        return twin

    def add(self, sequence: Iterable[int]) -> None:
        last = 0
        for word in sequence:
            if word in self.next[last]:
                last = self._split(last, word, self.next[last][word])
                continue
            new, source = self._state(self.length[last] + 1, {}, 0), last
            while source >= 0 and word not in self.next[source]:
                self.next[source][word] = new
                source = self.link[source]
            if source >= 0:
                self.link[new] = self._split(source, word, self.next[source][word])
            last = new

    def walk(self, sequence: Iterable[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: the state and the length of the longest run that ends at each word."""
        state, run = 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if word in self.next[state]:
                state, run = self.next[state][word], run + 1
            yield state, run

    def finish(self, templates: list[list[int]], phrases: list[list[int]]) -> None:
        """Gather what ends in each state; a place counts for the deepest of the states on a chain of links that has it."""
        own: list[set[tuple[int, int]]] = [set() for _ in self.next]
        self.ends, self.phrases = [[] for _ in self.next], [[] for _ in self.next]
        for k, sequence in enumerate(templates):
            for end, (state, _) in enumerate(self.walk(sequence)):
                own[state].add((k, end))
        for k, sequence in enumerate(phrases):
            self.phrases[list(self.walk(sequence))[-1][0]].append((k, len(sequence)))
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for state in reversed(by_length):
            own[self.link[state]] |= own[state]
        for state in by_length:
            self.phrases[state] += self.phrases[self.link[state]]
            at = state
            seen: set[tuple[int, int]] = set()
            while at > 0 and self.length[at] >= MIN_MATCH:
                self.ends[state] += [(*place, self.length[at]) for place in sorted(own[at] - seen)]
                seen |= own[at]
                at = self.link[at]


class Licences:
    """Templates, base phrases and their automaton, in the form that tasks use; built once and sent to them."""

    def __init__(self, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None):
        templates = TEMPLATES if templates is None else templates
        phrases = BASE_PHRASES if phrases is None else phrases
        number: dict[str, int] = {}
        as_numbers = lambda text: [number.setdefault(w, len(number) + 1) for w in words(text)]
        self.templates = [as_numbers(t) for _, t in templates]
        self.phrases = [as_numbers(t) for t, _ in phrases]
        self.template_labels, self.phrase_labels = [k for k, _ in templates], [k for _, k in phrases]
        self.automaton = Automaton()
        for sequence in self.templates + self.phrases:
            self.automaton.add(sequence)
        self.automaton.finish(self.templates, self.phrases)
        raw, at = textkit.buffers(pa.array(list(number) or [""], pa.string()))
        hashes, _ = textkit.word_hashes(raw, at, _APART)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array(list(number.values()), np.int64)[order] if number else np.zeros(0, np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        pairs = lambda sequences: {a * (len(number) + 1) + b for s in sequences for a, b in zip(s, s[1:])}
        self.base = len(number) + 1
        self.neighbours = np.array(sorted(pairs(self.templates + self.phrases)), np.int64)
        self.phrase_neighbours = np.array(sorted(pairs(self.phrases)), np.int64)

    def number_words(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for those in no template."""
        out = np.zeros(len(hashes), np.int64)
        near = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), max(len(self.hashes) - 1, 0))
        same = self.hashes[at] == hashes[near] if len(self.hashes) else np.zeros(len(near), bool)
        out[near[same]] = self.numbers[at[same]]
        return out


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _runs(known: Licences, numbers: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of the runs of neighbours that are long enough for a match or hold neighbours of a phrase."""
    if len(numbers) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
    pair = numbers[both] * known.base + numbers[both + 1]
    ends = word_at[1:-1] - 1
    one_text = np.ones(len(numbers), bool)
    one_text[ends[(ends >= 0) & (ends < len(numbers))]] = False
    fits = _among(pair, known.neighbours) & one_text[both]
    both, phrase = both[fits], _among(pair[fits], known.phrase_neighbours)
    if not len(both):
        return both, both
    opens = np.flatnonzero(np.concatenate(([True], np.diff(both) > 1)))
    closes = np.concatenate((opens[1:], [len(both)])) - 1
    first, last = both[opens], both[closes] + 1
    keep = (last - first + 1 >= MIN_MATCH) | (np.add.reduceat(phrase, opens) > 0)
    return first[keep], last[keep]


@dataclass
class Chain:
    template: int
    first: int
    last: int
    template_last: int
    covered: int
    match_first: int


def chain_matches(matches: list[tuple[int, int, int, int]]) -> list[Chain]:
    """The best chain that ends in each match (template, template start, text start, words), in the order of the text.

    A match follows another of its template when it ends later in both, with at most
    ``MAX_GAP`` words of text between them; what overlaps counts once. Only matches
    so near can precede it, so the work is linear in the matches of a text.
    """
    by_template: dict[int, list[Chain]] = {}
    out = []
    for template, start, first, size in sorted(matches, key=lambda m: (m[2] + m[3], m[2], m[0], m[1])):
        last, template_last = first + size - 1, start + size - 1
        best = Chain(template, first, last, template_last, size, first)
        own = by_template.setdefault(template, [])
        for before in reversed(own):
            if first - before.last - 1 > MAX_GAP:
                break
            if before.last >= last or before.template_last >= template_last:
                continue
            gain = size - max(0, before.last + 1 - first, before.template_last + 1 - start)
            if gain > 0 and before.covered + gain > best.covered:
                best = Chain(template, before.first, last, template_last, before.covered + gain, first)
        own.append(best)
        out.append(best)
    return out


def _spans(known: Licences, chains: list[Chain]) -> list[dict]:
    """Chains that cover enough of their template; of those of a template that overlap, the one that covers most."""
    out: list[dict] = []
    good = [(c.covered / len(known.templates[c.template]), c) for c in chains]
    taken: dict[int, list[tuple[int, int]]] = {}
    for share, c in sorted((x for x in good if x[0] >= MIN_SHARE), key=lambda x: (x[1].last, -x[0])):
        own = taken.setdefault(c.template, [])
        if own and own[-1][1] >= c.first:
            if out[own[-1][2]]["share"] >= share:
                continue
            out[own.pop()[2]] = {}
        own.append((c.first, c.last, len(out)))
        out.append({"label": known.template_labels[c.template], "template": c.template, "first_word": c.first, "last_word": c.last, "share": share})
    return [s for s in out if s]


def scan_words(known: Licences, numbers: np.ndarray, word_at: np.ndarray) -> list[tuple]:
    """(base places, first, last, base labels, labels, score, spans) of each of consecutive texts, given their words' numbers."""
    n = len(word_at) - 1
    places: dict[int, list[tuple[int, int]]] = {}
    matches: dict[int, list[tuple[int, int, int, int]]] = {}
    automaton = known.automaton
    first, last = _runs(known, numbers, word_at)
    texts = np.searchsorted(word_at, first, "right") - 1
    for begin, end, text in zip(first.tolist(), last.tolist(), texts.tolist()):
        offset = begin - int(word_at[text])
        own = numbers[begin : end + 1].tolist()
        for k, (state, run) in enumerate(automaton.walk(own)):
            for phrase, size in automaton.phrases[state]:
                if size <= run:
                    places.setdefault(text, []).append((offset + k - size + 1, phrase))
            if run < MIN_MATCH:
                continue
            following = own[k + 1] if k + 1 < len(own) else None
            for template, stop, most in automaton.ends[state]:
                size, words_of = min(run, most), known.templates[template]
                if stop + 1 == len(words_of) or words_of[stop + 1] != following:
                    matches.setdefault(text, []).append((template, stop - size + 1, offset + k - size + 1, size))
    out = []
    for k in range(n):
        base, found = places.get(k, []), _spans(known, chain_matches(matches.get(k, [])))
        starts, base_labels = [p for p, _ in base], {known.phrase_labels[i] for _, i in base}
        labels = base_labels | {s["label"] for s in found}
        score = 1.0 if base else max((min(s["share"], 1.0) for s in found), default=0.0)
        out.append((len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, found))
    return out


_SPAN = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())])
_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,template:int,first_word:long,last_word:long,share:double>>"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Licences | None = None) -> DataFrame:
    """Licences of every whole text.

    Returns the id (of any type), n_words, n_base (places of base phrases), first_word
    and last_word (their smallest and largest start in words from 0, null if none),
    base_labels, labels (with those of templates; both sorted, comma-joined, empty if
    none), score (1 with a base phrase, else the largest share of a template that one
    chain covers, if that is enough for a label, else 0) and spans (label, template,
    first and last word, share). A null or empty text has no words. Repeated rows
    each have their row; further columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known or Licences())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        licences = sent.value
        for batch in batches:
            raw, at = textkit.buffers(batch.column(1))
            for first, last in textkit.slices(at):
                hashes, word_at = textkit.word_hashes(raw, at[first : last + 1], _APART)
                found = scan_words(licences, licences.number_words(hashes), word_at)
                columns = [pa.array(np.diff(word_at)), *(pa.array([f[k] for f in found], kind) for k, (_, kind) in enumerate(_FIELDS[1:]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], names=[id_col, *(name for name, _ in _FIELDS)])

    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {_SCHEMA}")
