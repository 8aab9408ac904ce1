"""Licence scans with a generalised suffix automaton over the words of licence templates.

A document's words are streamed through the automaton, which gives the matching statistic of each
place: the longest suffix ending there that occurs in some template. Maximal long matches, at every place
of the template that has them, are chained per template, in the order of both texts, by dynamic
programming over what a chain covers, and chains that cover enough of a template become labelled spans. The words that tell a licence from its relatives (versions, variant names) must lie
whole within one match, so that a chain never skips them. Exact phrases add their own labels and places.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from kinsift.llm.text import map_texts

#: UTF-8 bytes to word bytes: ASCII letters in lower case, digits and all bytes above 127 as they are, the rest to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


# Phrases and the labels that they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licence notices, by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Passages that decide between relatives: a span needs each that its template has, unbroken in the text.
DECIDING: dict[str, list[str]] = {
    "apache-2.0": ["apache license version 2"],
    "gpl-2.0": ["gnu general public license as", "version 2 of"],
    "gpl-3.0": ["gnu general public license as", "gnu general public license version 3", "version 3 of"],
    "mpl-2.0": ["mozilla public license v 2"],
}


def _add(label: str, text: str, *deciding: str) -> None:
    if (label, text) not in TEMPLATES:
        TEMPLATES.append((label, text))
    DECIDING[label] = list(dict.fromkeys([*DECIDING.get(label, []), *deciding]))


# Creative Commons: every variant by every version's name, and without one.
for _code, _name in [
    ("by", "Attribution"),
    ("by-nc", "Attribution-NonCommercial"),
    ("by-sa", "Attribution-ShareAlike"),
    ("by-nd", "Attribution-NoDerivatives"),
    ("by-nd", "Attribution-NoDerivs"),
    ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
    ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
    ("by-nc-nd", "Attribution-NonCommercial-NoDerivs"),
]:
    for _version in ("4.0 International ", "3.0 Unported ", "2.5 Generic ", "2.0 Generic ", "1.0 Generic ", ""):
        _number = _version[:3]
        _add(f"cc-{_code}", f"This work is licensed under a Creative Commons {_name} {_version}License", f"commons {_name} {_number or 'license'}")
        _add(f"cc-{_code}", f"Licensed under CC {_code.upper()} {_number}".strip(), f"under cc {_code} {_number}")

for _number in ("2.0", "1.1", "1.0"):
    for _as in (", Version ", " ", " v"):
        _add(f"apache-{_number}", f"Licensed under the Apache License{_as}{_number}", f"apache license{_as}{_number.removesuffix('.0') if _number == '2.0' else _number}")

for _label, _name, _number in [
    ("gpl-2.0", "GNU General Public License", "2"),
    ("gpl-3.0", "GNU General Public License", "3"),
    ("lgpl-2.0", "GNU Library General Public License", "2"),
    ("lgpl-2.1", "GNU Lesser General Public License", "2.1"),
    ("lgpl-3.0", "GNU Lesser General Public License", "3"),
    ("agpl-3.0", "GNU Affero General Public License", "3"),
]:
    for _as in (", version ", " v"):
        _add(_label, f"This work is licensed under the {_name}{_as}{_number}", f"{_name}{_as}{_number}")
    _free = f"This program is free software; you can redistribute it and/or modify it under the terms of the {_name}"
    _add(_label, f"{_free} version {_number} as published by the Free Software Foundation.")
    _add(_label, f"{_free} as published by the Free Software Foundation; either version {_number} of the License, or (at your option) any later version.", f"{_name} as", f"version {_number} of")

for _number in ("1.1", "1.0"):
    _add(f"mpl-{_number}", f'The contents of this file are subject to the Mozilla Public License Version {_number} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/', f"mozilla public license version {_number}")

# Short names, with their versions.
for _label, _names in {
    "gpl-2.0": ["GNU General Public License version 2", "GNU General Public License v2"],
    "gpl-3.0": ["GNU General Public License version 3", "GNU General Public License v3"],
    "lgpl-2.1": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1"],
    "lgpl-3.0": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3"],
    "agpl-3.0": ["GNU Affero General Public License version 3", "GNU Affero General Public License v3"],
    "epl-1.0": ["Eclipse Public License 1.0", "Eclipse Public License version 1.0", "Eclipse Public License v1.0"],
    "epl-2.0": ["Eclipse Public License 2.0", "Eclipse Public License version 2.0", "Eclipse Public License v2.0"],
    "mpl-2.0": ["Mozilla Public License 2.0", "Mozilla Public License version 2.0"],
    "artistic-1.0": ["Artistic License 1.0", "Artistic License version 1.0"],
    "artistic-2.0": ["Artistic License 2.0", "Artistic License version 2.0"],
    "bsd-2-clause": ["BSD 2-Clause License", "Simplified BSD 2-Clause License"],
    "bsd-3-clause": ["BSD 3-Clause License", "New or Revised BSD 3-Clause License"],
    "boost-1.0": ["Boost Software License Version 1.0", "Boost Software License 1.0"],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}.items():
    for _name in _names:
        _add(_label, _name, *([_name] if len(words_of(_name.encode())) < 12 else []))

# Identifiers in source files.
for _label, _code in [("mit", "MIT"), ("isc", "ISC"), ("apache-2.0", "Apache-2.0"), ("gpl-2.0", "GPL-2.0"), ("gpl-3.0", "GPL-3.0"), ("lgpl-2.1", "LGPL-2.1"), ("lgpl-3.0", "LGPL-3.0"), ("agpl-3.0", "AGPL-3.0"), ("mpl-2.0", "MPL-2.0"), ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("epl-2.0", "EPL-2.0"), ("unlicense", "Unlicense"), ("zlib", "Zlib"), ("cc0", "CC0-1.0")]:
    _add(_label, f"SPDX-License-Identifier: {_code}", f"license identifier {_code}")

#: Words that, right after a span, make it another variant's.
VARIANTS = ["nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike"]

#: Words of a match that can begin or extend a chain; words that a chain may skip in either text; share of a template that a span must cover.
LEAST, GAP, COVER = 4, 16, 0.6

class Automaton:
    """Generalised suffix automaton: states with transitions by word id, suffix links and lengths;
    ends[s] holds, for each text that the state's strings occur in, all places where they end."""

    def __init__(self, texts: list[list[int]]):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [{}]
        for number, text in enumerate(texts):
            state = 0
            for at, word in enumerate(text):
                state = self._extend(state, word)
                self.ends[state].setdefault(number, set()).add(at + 1)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.ends[self.link[s]]
            for number, at in self.ends[s].items():
                up.setdefault(number, set()).update(at)

    def _add(self, length: int, copied: int | None = None) -> int:
        self.next.append({} if copied is None else dict(self.next[copied]))
        self.link.append(0 if copied is None else self.link[copied])
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state of parent's strings followed by word, on its own."""
        child = self.next[parent][word]
        if self.length[child] == self.length[parent] + 1:
            return child
        clone = self._add(self.length[parent] + 1, child)
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # an earlier text came this way
            return self._split(last, word)
        new, p = self._add(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        self.link[new] = self._split(p, word) if p >= 0 else 0
        return new

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(start, length, state) of each match of at least ``least`` words that cannot go on to the right."""
        state = size = 0
        for at, word in enumerate(words):
            before, had = state, size
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                size = 0
            if had >= least and size <= had:
                yield at - had, had, before
        if size >= least:
            yield len(words) - size, size, state


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], least: int = LEAST, gap: int = GAP, cover: float = COVER, deciding: dict[str, list[str]] | None = None):
        self.least, self.gap, self.cover = least, gap, cover
        cut = [words_of(text.encode()) for _, text in templates]
        self.ids: dict[bytes, int] = {}
        for words in [*cut, *(words_of(p.encode()) for p in phrases)]:
            for w in words:
                self.ids.setdefault(w, len(self.ids))
        self.labels, self.sizes = [label for label, _ in templates], [len(w) for w in cut]
        self.longest = max(self.sizes, default=0)
        self.automaton = Automaton([[self.ids[w] for w in words] for words in cut])
        passages = {label: [words_of(p.encode()) for p in of] for label, of in (DECIDING if deciding is None else deciding).items()}
        self.deciding = [[(k, k + len(p)) for p in passages.get(label, []) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p] for label, w in zip(self.labels, cut, strict=True)]
        self.variants = {self.ids[v.encode()] for v in VARIANTS if v.encode() in self.ids}
        self.phrases = [([self.ids[w] for w in words_of(p.encode())], label) for p, label in phrases.items()]

    def spans(self, found: list[tuple[int, int, int]], ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template) of the chains that cover enough and have what decides."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, size, state in found:
            for number, ends in self.automaton.ends[state].items():
                by_template.setdefault(number, []).extend((start, end - size, size) for end in sorted(ends))
        out = []
        for number, parts in by_template.items():
            if sum(size for _, _, size in parts) < self.cover * self.sizes[number]:
                continue
            best, before = [size for *_, size in parts], [-1] * len(parts)
            for i, (start, at, size) in enumerate(parts):
                for j in range(i - 1, -1, -1):  # starts fall; a match that ended more than the gap before is followed by none
                    first, place, words = parts[j]
                    if start - first > self.gap + self.longest:
                        break
                    past, there = start + size - first - words, at + size - place - words  # how far this one goes beyond that one
                    new = min(size, past, there)
                    if new > 0 and past - size <= self.gap and there - size <= self.gap and best[j] + new > best[i]:
                        best[i], before[i] = best[j] + new, j
            used: set[int] = set()
            for i in sorted(range(len(parts)), key=lambda i: -best[i]):
                if best[i] < self.cover * self.sizes[number]:
                    break
                chain = [i]
                while before[chain[-1]] >= 0:
                    chain.append(before[chain[-1]])
                first, end = parts[chain[-1]][0], parts[i][0] + parts[i][2]
                whole = [(parts[k][1], parts[k][1] + parts[k][2]) for k in chain]
                if used.isdisjoint(chain) and self._decided(number, whole) and not (end < len(ids) and int(ids[end]) in self.variants):
                    used.update(chain)
                    out.append((self.labels[number], first, end, min(1.0, best[i] / self.sizes[number])))
        return out

    def _decided(self, number: int, whole: list[tuple[int, int]]) -> bool:
        return all(any(a <= first and end <= b for a, b in whole) for first, end in self.deciding[number])

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Number of words, (start, label) of each phrase, spans of templates."""
        words = words_of(text)
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        base = []
        for phrase, label in self.phrases:
            at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
            for k, w in enumerate(phrase[1:], 1):
                at = at[ids[at + k] == w]
            base += [(int(a), label) for a in at]
        # a match lies inside a run of template words
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        found = []
        for a, b in zip(starts[ends - starts >= self.least].tolist(), ends[ends - starts >= self.least].tolist(), strict=True):
            found += [(a + start, size, state) for start, size, state in self.automaton.matches(ids[a:b].tolist(), self.least)]
        return len(words), base, self.spans(found, ids) if found else []


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(TEMPLATES, PHRASES)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, phrases (array of start and label), spans (array of label,
    first word, end, share of the template).

    Words are letters, digits and non-ASCII characters, A-Z lower-cased. Null texts count as empty:
    no words, empty arrays. Repeated rows stay repeated; other columns are not looked at; an empty
    table gives no rows. Nothing is shuffled; the templates are fixed and built once per worker.
    """

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for i, x in pairs:
            n, base, spans = scanner().scan(x)
            yield i, n, [{"start": a, "label": b} for a, b in base], [{"label": a, "start": b, "end": c, "share": d} for a, b, c, d in spans]

    return map_texts(docs, doc_id, text, "doc_id bigint, n_words bigint, phrases array<struct<start:bigint,label:string>>, spans array<struct<label:string,start:bigint,end:bigint,share:double>>", rows)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: the largest covered share of a template, at least one half where a phrase stands."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(phrases) as bigint) as n_base",
        "array_min(phrases.start) as first_word",
        "array_max(phrases.start) as last_word",
        "array_join(array_sort(array_distinct(phrases.label)), ',') as base_labels",
        "array_join(array_sort(array_distinct(concat(phrases.label, spans.label))), ',') as labels",
        "greatest(coalesce(array_max(spans.share), 0.0D), if(size(phrases) > 0, 0.5D, 0.0D)) as score",
    )
