"""License scans by patience alignment.

A template is looked for around its rare words.  The words that are unique both in that part
of the text and in the template are anchors; the longest increasing subsequence of them keeps
those in the same order; between two anchors, and before the first and after the last, the
gaps are aligned in the same way with the words unique there, and equal words next to an
anchor are taken along.  Coverage is the share of the template's words that are aligned.

A match of coverage ``COVERAGE`` misses less than the rest of the template, so it holds at
least one of the template's markers: its rarest words, as many as make up that rest.
Texts without a marker cannot match and are not aligned; every other text is, whole.

Scale: one pass without a shuffle; templates are a parameter of a few kilobytes.  Work per
text is one hash per word, and alignments only around markers; a part is at most three
templates long, so long texts cost no more than their length.

Defined results: a null or empty text has no licenses; several parts of one license are
several spans; of parts that overlap, the one with most template words stays (ties: the shorter,
then the earlier, then by name); rows are
independent, so repeated rows and ids get a row each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.text import Hasher, map_texts, runs, slices, split_words

COVERAGE = 0.8

#: Wording of public licenses and of the usual notices that refer to them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
}


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out: list[int] = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned places (text, template) of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        pairs = [(place[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in place]
        pairs = [pairs[k] for k in increasing([i for i, _ in pairs])]
        if not pairs:
            continue
        out += pairs
        ends = [(a - 1, c - 1), *pairs, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


class _Template:
    def __init__(self, name: str, words: list[int], spread: Counter, coverage: float) -> None:
        self.name, self.words = name, words
        self.needed = coverage * len(words)
        self.counts = Counter(words)
        #: Words that a match spans at most.
        self.reach = len(words) + len(words) // 2
        # Rarest among the templates first, until no match can do without all of them.
        self.markers: set[int] = set()
        missed, count = 0, self.counts
        for w in sorted(count, key=lambda w: (spread[w], count[w], words.index(w))):
            if missed > len(words) - self.needed:
                break
            self.markers.add(w)
            missed += count[w]


def _templates(texts: dict[str, str], coverage: float) -> list[_Template]:
    words = split_words(pa.array(list(texts.values()), pa.large_string()), Hasher())
    ends = runs(words.row, len(texts))
    lists = [words.code[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
    spread = Counter(w for x in lists for w in set(x))
    return [_Template(n, x, spread, coverage) for n, x in zip(texts, lists, strict=True) if x]


def _parts(places: list[int], size: int, words: int) -> Iterator[tuple[int, int]]:
    """Runs of words around markers; every match lies in one, being at most 1.5 templates long."""
    reach = size + size // 2
    start = stop = None
    for p in places:
        if start is not None and p - reach <= stop and stop - start < 2 * reach:
            stop = p + reach
            continue
        if start is not None:
            yield max(0, start), min(words, stop)
        start, stop = p - reach, p + reach
    if start is not None:
        yield max(0, start), min(words, stop)


def matches(words: list[int], templates: list[_Template],
            where: dict[int, list[int]]) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, last word) of all matches that do not overlap."""
    found = []
    for t in templates:
        places = sorted(p for m in t.markers for p in where.get(m, ()))
        for a, b in _parts(places, len(t.words), len(words)):
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                if not _may_match(words[a:b], t):
                    continue
                pairs = align(words[a:b], t.words)
                span = _tightest(pairs, t)
                if span is None:
                    # A second copy makes words ambiguous: look at each half as well.
                    if b - a > 2 * len(t.words):
                        mid, lap = (a + b) // 2, len(t.words) * 3 // 4
                        todo += [(a, mid + lap), (mid - lap, b)] if b - a > 4 * lap else []
                    continue
                first, last, covered = span
                found.append((t.name, covered / len(t.words), a + first, a + last))
                todo += [(a, a + first), (a + last + 1, b)]
    # The template with most words found wins, so a whole one wins over a part of it.
    size = {t.name: len(t.words) for t in templates}
    found = sorted(set(found), key=lambda m: (-round(m[1] * size[m[0]]), m[3] - m[2], m[2], m[0]))
    kept: list[tuple[str, float, int, int]] = []
    for m in found:
        if all(m[3] < k[2] or k[3] < m[2] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[2])


def _may_match(words: list[int], t: _Template) -> bool:
    """Whether enough of the template's words stand close enough together, in whatever order.

    Two bounds that no alignment can beat: the template's words that are there at all, each as
    often as it is in both; and its words within the longest span of a match.
    """
    if len(words) < t.needed:
        return False
    there = Counter(w for w in words if w in t.counts)
    if sum(min(n, t.counts[w]) for w, n in there.items()) < t.needed:
        return False
    sums = [0, *accumulate(w in t.counts for w in words)]
    reach = min(t.reach, len(words))
    return max(sums[i + reach] - sums[i] for i in range(len(words) - reach + 1)) >= t.needed


def _tightest(pairs: list[tuple[int, int]], t: _Template) -> tuple[int, int, int] | None:
    """First word, last word and aligned words of the alignment without far-off ends."""
    reach = t.reach
    while pairs and pairs[-1][0] - pairs[0][0] >= reach:
        # The end that is farther from its neighbour goes.
        pairs = pairs[1:] if pairs[1][0] - pairs[0][0] >= pairs[-1][0] - pairs[-2][0] else pairs[:-1]
    if len(pairs) < t.needed:
        return None
    return pairs[0][0], pairs[-1][0], len(pairs)


def _scan(texts: dict[str, str], coverage: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, templates = Hasher(), _templates(texts, coverage)
        markers = np.unique(np.array(sorted({m for t in templates for m in t.markers}), dtype=np.uint64))
        for piece in (p for b in batches for p in slices(b, "text")):
            words = split_words(piece.column("text"), hasher)
            ends = runs(words.row, piece.num_rows)
            near = np.minimum(np.searchsorted(markers, words.code), len(markers) - 1)
            marked = np.flatnonzero(markers[near] == words.code)
            lead = None
            found: list[list] = [[] for _ in range(piece.num_rows)]
            for row in np.unique(words.row[marked]).tolist():
                a, b = ends[row], ends[row + 1]
                where: dict[int, list[int]] = {}
                for p in marked[np.searchsorted(marked, a):np.searchsorted(marked, b)].tolist():
                    where.setdefault(int(words.code[p]), []).append(p - a)
                own = matches(words.code[a:b].tolist(), templates, where)
                if own and lead is None:
                    lead = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                base = words.offsets[row]
                found[row] = [(n, c, int(lead[words.start[a + i]] - lead[base]),
                               int(lead[words.end[a + j]] - lead[base])) for n, c, i, j in own]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            lists = [pa.array([[m[k] for m in x] for x in found], pa.list_(kinds[k])) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc"), *lists], names=["doc", "licenses", "coverage", "starts", "ends"])

    return task


def scan(docs: DataFrame, keep: Column, templates: dict[str, str] = TEMPLATES,
         coverage: float = COVERAGE) -> DataFrame:
    """doc (as ``keep`` says) and, in order of the text: licenses, coverage, starts, ends."""
    narrow = docs.select(keep.alias("doc"), "text")
    return map_texts(narrow, _scan(templates, coverage),
        f"doc {narrow.schema['doc'].dataType.simpleString()}, licenses array<string>, "
        "coverage array<double>, starts array<long>, ends array<long>")


def report(docs: DataFrame) -> DataFrame:
    """Per document: how many license passages, which licenses, and where."""
    told = scan(docs, F.col("doc_id"))
    span = F.transform(
        F.arrays_zip("licenses", "starts", "ends"),
        lambda m: F.concat_ws(":", m["licenses"], m["starts"].cast("string"), m["ends"].cast("string")))
    return told.select(
        F.col("doc").alias("doc_id"), F.size("licenses").cast("long").alias("n_passages"),
        F.array_join(F.array_sort(F.array_distinct("licenses")), ",").alias("licenses"),
        F.array_max("coverage").alias("best_coverage"), F.array_join(span, ",").alias("spans"))
