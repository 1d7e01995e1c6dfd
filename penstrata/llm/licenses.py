"""License scans by patience alignment.

A template is aligned with the text about its distinctive words. Words that
are unique to both sides anchor the alignment: the longest increasing
subsequence of their places is kept, and the gaps between anchors are aligned
the same way, down to gaps without a common unique word, which keep what they
share at either end. Coverage is the share of the template's words matched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a match must cover of its template, and of the text from its first to its last word.
LEAST_COVERAGE, LEAST_DENSITY = 0.8, 0.6
#: Templates of fewer words must be covered whole: one word of theirs tells licenses apart.
SHORT = 12
#: Notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}
#: Words that tell no license from other prose.
COMMON = frozenset("a an and any are as at be by can for free from in is it may must not of on or other that the this to under use with without work you your".split())
_WORD = re.compile(r"[a-z0-9]+(?:[.\-'][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of ``pairs``, ascending in the first place, that ascends in the second."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        ends[k : k + 1], at[k : k + 1] = [j], [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of matched words of ``a`` and ``b`` by patience alignment, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        na, nb = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {w: j for j, w in enumerate(b[j0:j1], j0) if nb[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[i0:i1], i0) if na[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        edges = [(i0 - 1, j0 - 1), *anchors, (i1, j1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Scanner:
    """Finds the templates in whole texts."""

    def __init__(self, templates: dict[str, list[str]] | None = None) -> None:
        self.rules = []
        for name, texts in (TEMPLATES if templates is None else templates).items():
            for t in texts:
                words = words_of(t)
                telling = {w for w in words if w not in COMMON}
                # a match may miss so many words, and so must hold the rest of the distinctive ones
                need = len(words) if len(words) < SHORT else ceil(LEAST_COVERAGE * len(words))
                if words:
                    self.rules.append((name, words, telling, max(1, len(telling) - (len(words) - need)), need))
        self.telling = frozenset().union(*(r[2] for r in self.rules)) if self.rules else frozenset()

    def regions(self, words: list[str], telling: set[str], n: int) -> list[tuple[int, int]]:
        """Runs of text about distinctive words that lie within ``n`` words of one another, with ``n`` words on either side."""
        out: list[list[int]] = []
        for i, w in enumerate(words):
            if w in telling:
                if out and i - out[-1][1] <= n:
                    out[-1][1] = i
                else:
                    out.append([i, i])
        return [(max(0, a - n), min(len(words), b + n + 1)) for a, b in out]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of every template found, best first; the first place of each."""
        if not text:
            return []
        words = words_of(text)
        here = self.telling.intersection(words)
        if not here:
            return []
        best: dict[str, tuple[float, int, int, int]] = {}
        for name, template, telling, least, need in self.rules:
            if len(telling & here) < least:
                continue
            for a, b in self.regions(words, telling, len(template)):
                for first, last, matched in self._matches(words[a:b], template, need):
                    coverage = matched / len(template)
                    found = (coverage, matched, -(a + first), -(a + last))
                    if found > best.get(name, (0.0, 0, 0, 0)):
                        best[name] = found
        order = sorted(best.items(), key=lambda kv: (*(-x for x in kv[1][:2]), kv[0]))
        return [(name, f[0], -f[2], -f[3]) for name, f in order]

    def _matches(self, words: list[str], template: list[str], need: int) -> Iterator[tuple[int, int, int]]:
        """Dense matches in a region. Stray words far off are left at the sides, and a repeated notice, whose words are unique nowhere in the whole, is met in windows about its length, every half of it and where its first two words stand."""
        n = len(template)
        spans = [(0, len(words))]
        if len(words) > n:
            begins = {i for i in range(len(words) - n + 1) if words[i : i + 2] == template[:2]}
            spans += [(s, s + 2 * n) for s in sorted(begins.union(range(0, len(words) - n, max(1, n // 2))))]
        for s, e in spans:
            pairs = aligned(words[s:e], template)
            while len(pairs) >= need:
                first, last = pairs[0][0], pairs[-1][0]
                if len(pairs) >= LEAST_DENSITY * (last - first + 1):
                    yield s + first, s + last, len(pairs)
                    break
                left, right = pairs[1][0] - first, last - pairs[-2][0]
                pairs = pairs[1:] if left >= right else pairs[:-1]


def scanned(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word, licenses) of every row.

    ``license`` is the one of best coverage (then more words, then name) and
    ``licenses`` lists all found; places count the text's words from 0. Null
    where there is none, as for null and empty texts. Repeated rows each come
    back; an empty table gives none. Other columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            got = [scanner.scan(t) for t in b.column(1).to_pylist()]
            top = [g[0] if g else (None,) * 4 for g in got]
            cols = [pa.array([t[i] for t in top], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([[x[0] for x in g] for g in got], pa.list_(pa.string()))], names=["doc_id", "license", "coverage", "first_word", "last_word", "licenses"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, license string, coverage double, first_word int, last_word int, licenses array<string>")
