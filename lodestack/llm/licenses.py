"""Licence scans: passages against templates by the Dice coefficient of their word bigrams.

Passages are the lines of a text, its paragraphs of several lines (between lines that are blank but
for comment marks), the whole text, and windows of its words wherever a template matches inside or
across these. Of windows that share half of their joint span the best is kept; a window in a line or
paragraph found for the same licence is not told again. Passages and templates are normalised to lower-case words without punctuation, and
compared as sets of word bigrams; a one-word text is its own bigram. A Dice coefficient of t or
more asks for sizes within t / (2 - t) and (2 - t) / t of each other, and for t / (2 - t) of the
template's bigrams in the text, which prunes templates before anything is compared. A window starts
and ends with a bigram of its template, as others at its ends only lower the coefficient; it has at
most (2 - t) / t times the template's words, repeats counted, so the work grows with the text alone.

Cases. Null, empty or blank text: no rows. Equal best templates: the first name in order. Rows of
one doc_id are scanned each for itself; a null doc_id is carried. An empty table or no templates:
no rows. Other columns take no part.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import column, lean, table
from lodestack.llm.licence_texts import TEXTS

LEAST_DICE = 0.8
FOUND = "doc_id long, licence string, dice double, passage string, first_line int, n_lines int"
#: Notices by the licence they declare (fixed values).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "all-rights-reserved": ["All rights reserved."],
}
for _name, _texts in TEXTS.items():
    TEMPLATES.setdefault(_name, []).extend(_texts)
MARKS = " \t\r\f\v#*/;%!-<>\"'"  # what a comment puts on an empty line
_WORD = re.compile(r"\w+")


def bigrams(text: str) -> frozenset:
    ws = _WORD.findall(text.lower())
    return frozenset(zip(ws, ws[1:])) if len(ws) > 1 else frozenset((w,) for w in ws)


class Templates:
    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least = least
        self.all = [(name, bigrams(t)) for name, texts in sorted(templates.items()) for t in texts if bigrams(t)]
        words = [len(_WORD.findall(t.lower())) for _, texts in sorted(templates.items()) for t in texts if bigrams(t)]
        self.widths = [math.ceil(n * (2 - least) / least) for n in words]
        self.by_bigram = defaultdict(list)
        for n, (_, b) in enumerate(self.all):
            for g in b:
                self.by_bigram[g].append(n)
        self.least_shared = [len(b) * least / (2 - least) - 1e-9 for _, b in self.all]

    def possible(self, ws: list[str]) -> set[int]:
        """Templates of which a text of these words has enough bigrams for any passage to match."""
        shared = defaultdict(int)
        for found in (set(zip(ws, ws[1:])), {(w,) for w in ws}):
            for g in found & self.by_bigram.keys():
                for n in self.by_bigram[g]:
                    shared[n] += 1
        return {n for n, k in shared.items() if k >= self.least_shared[n]}

    def best(self, passage: str, among: set[int]) -> tuple[str, float] | None:
        ws = _WORD.findall(passage.lower())
        found = frozenset(zip(ws, ws[1:])) if len(ws) > 1 else frozenset((w,) for w in ws)
        size = len(found)
        shared = defaultdict(int)
        for g in found:
            for n in self.by_bigram.get(g, ()):
                if n in among:
                    shared[n] += 1
        best = None
        for n in sorted(shared):
            m = len(self.all[n][1])
            if m * self.least > (2 - self.least) * size or size * self.least > (2 - self.least) * m:
                continue
            dice = 2 * shared[n] / (size + m)
            if dice >= self.least and (best is None or dice > best[1]):
                best = (self.all[n][0], dice)
        return best

    def _promising(self, pairs: list, at: list[int], template: frozenset, width: int) -> list[bool]:
        """For each of the places `at`, whether a window of `width` from it has enough of the template."""
        need, counts, j, out = len(template) * self.least / (2 - self.least) - 1e-9, defaultdict(int), 0, []
        for first in at:
            while j < len(at) and at[j] < first + width:
                counts[pairs[at[j]]] += 1
                j += 1
            out.append(len(counts) >= need)
            counts[pairs[first]] -= 1
            if not counts[pairs[first]]:
                del counts[pairs[first]]
        return out

    def _reach(self, pairs: list, at, template: frozenset, width: int) -> tuple[float, int]:
        """Best coefficient of a window from the first of the places `at` to one of them not `width`
        further, and that place."""
        m, seen, shared, best, last, first = len(template), set(), set(), (0.0, -1), None, None
        for k in at:
            first = k if first is None else first
            if abs(k - first) >= width:
                break
            between = () if last is None else pairs[min(last, k) : max(last, k)]
            seen.update(between)
            seen.add(pairs[k])
            shared.add(pairs[k])
            last = k
            if len(seen) * self.least > (2 - self.least) * m:
                break
            dice = 2 * len(shared) / (len(seen) + m)
            if dice > best[0]:
                best = (dice, k)
        return best

    def windows(self, ws: list[str], among: set[int]) -> list[tuple[float, str, int, int]]:
        """(dice, licence, first word, last word) of windows that match a template."""
        pairs, found, widest = list(zip(ws, ws[1:])), [], 0
        for n in sorted(among):
            (name, template), width = self.all[n], self.widths[n]
            widest = max(widest, width)
            at = [k for k, g in enumerate(pairs) if g in template]
            hopeful = self._promising(pairs, at, template, width)
            i = 0
            while i < len(at):
                dice, end = self._reach(pairs, (at[k] for k in range(i, len(at))), template, width) if hopeful[i] else (0.0, -1)
                if dice < self.least:
                    i += 1
                    continue
                j = bisect_left(at, end)
                dice, start = self._reach(pairs, (at[k] for k in range(j, -1, -1)), template, width)
                found.append((dice, name, start, end + 1))
                i = j + 1
        kept: list[tuple[int, int, float, str]] = []  # by first word
        for dice, name, a, b in sorted(found, key=lambda x: (-x[0], x[2] - x[3], x[1])):
            near = kept[bisect_left(kept, (a - widest - 1,)) : bisect_left(kept, (b + 1,))]
            if all(2 * (min(b, d) - max(a, c) + 1) < max(b, d) - min(a, c) + 1 for c, d, *_ in near):
                insort(kept, (a, b, dice, name))
        return [(dice, name, a, b) for a, b, dice, name in kept]

    def scan(self, text: str):
        """(licence, dice, kind, first line, lines) of each passage that matches a template."""
        all_words = _WORD.findall(text.lower())
        among = self.possible(all_words)
        if not among:
            return
        lines, told = text.split("\n"), []
        start, paragraphs = None, []
        for n, line in enumerate([*lines, ""]):
            if hit := self.best(line, among):
                yield *hit, "line", n, 1
                told.append((hit[0], n, n + 1))
            if line.strip(MARKS):
                start = n if start is None else start
            elif start is not None:
                paragraphs.append((start, n))
                start = None
        for a, b in paragraphs:
            if b - a > 1 and (hit := self.best(" ".join(lines[a:b]), among)):
                yield *hit, "paragraph", a, b - a
                told.append((hit[0], a, b))
        if len(paragraphs) > 1 and (hit := self.best(" ".join(lines), among)):
            yield *hit, "text", 0, len(lines)
        line_of = [n for n, line in enumerate(lines) for _ in _WORD.findall(line.lower())]
        for dice, name, start, end in self.windows(all_words, among):
            a, b = line_of[start], line_of[end] + 1
            if not any(name == x and c <= a and b <= d for x, c, d in told):
                yield name, dice, "window", a, b - a


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """One row per passage that a template matches, with its best template."""
    index = Templates(templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.int32()]
        names = ["doc_id", "licence", "dice", "passage", "first_line", "n_lines"]
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in index.scan(t.as_py() or "")]
            yield pa.RecordBatch.from_arrays([column([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), FOUND)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
