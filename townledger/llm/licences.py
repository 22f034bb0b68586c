"""Licence scan: stretches of a document's words compared with licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import heapq
import pkgutil
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lines that ``Matcher.scan`` compares as one; ``Matcher.find`` and the query know no such limit.
SPAN = 8
THRESHOLD = 0.8

# Short public notices and grants by which licences are named in texts.
TEMPLATES = {
    "all-rights-reserved": ("All rights reserved.",),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "bsd-2-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies.",),
    "mit": ("Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

# Licences whose whole text is a template as well (``licence_texts``).
WHOLE = ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0", "gpl-3.0", "isc", "mit", "mpl-2.0")

_TOKEN = re.compile(r"[a-z0-9]+")


def whole_texts() -> dict[str, str]:
    return {x: pkgutil.get_data(__package__, f"licence_texts/{x}.txt").decode() for x in WHOLE}


def words(text: str) -> list[str]:
    """Normal form: letters and digits of ASCII in lower case; everything else separates."""
    return _TOKEN.findall(text.lower())


def bigrams(w: list[str]) -> set[tuple[str, str]]:
    return set(zip(w, w[1:]))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@dataclass
class Matcher:
    """Templates by size and by bigram. Dice(a, b) >= t needs t / (2 - t) <= |b| / |a| <= (2 - t) / t."""

    threshold: float = THRESHOLD
    templates: dict[str, tuple[str, ...]] | None = None
    texts: dict[str, str] | None = None

    def __post_init__(self):
        all_ = [(len(b := bigrams(words(t))), name, k, b) for name, texts in (self.templates or TEMPLATES).items() for k, t in enumerate(texts)]
        all_ += [(len(b := bigrams(words(t))), name, -1, b) for name, t in (self.texts or {}).items()]  # -1 marks a whole text
        self.known = sorted(all_, key=lambda x: x[:3])
        self.sizes = [x[0] for x in self.known]
        self.by_bigram: dict[tuple[str, str], list[int]] = {}
        for i, x in enumerate(self.known):
            for g in x[3]:
                self.by_bigram.setdefault(g, []).append(i)
        self.low, self.high = self.threshold / (2 - self.threshold), (2 - self.threshold) / self.threshold
        self.longest = int(self.sizes[-1] * self.high) if self.sizes else 0

    def best(self, grams: set) -> tuple[float, str, int] | None:
        """The best template for a set of bigrams; ties go to the first name, then the first of its texts."""
        n = len(grams)
        lo, hi = bisect_left(self.sizes, self.low * n - 1e-9), bisect_right(self.sizes, self.high * n + 1e-9)
        if lo == hi or not n:
            return None
        hits: dict[int, int] = {}
        for g in grams:
            for i in self.by_bigram.get(g, ()):
                if lo <= i < hi:
                    hits[i] = hits.get(i, 0) + 1
        found = [(-2 * c / (n + self.sizes[i]), self.known[i][1], self.known[i][2]) for i, c in hits.items() if 2 * c >= self.threshold * (n + self.sizes[i]) - 1e-9]
        if not found:
            return None
        score, name, k = min(found)
        return -score, name, k

    def find(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(licence, first line, number of lines, Dice) of every notice in the sequence of all words, lines not regarded.

        Every stretch of words is compared with every template; the best one is a notice, then the best of those that share no
        word with it, and so on; ties go to fewer words, the earlier stretch and the first name. Whole texts go before notices,
        of which they hold some. A stretch whose outer bigram is
        not the template's, or comes once more inside, scores no better than the shorter one without it and is left out. For
        each start only a bound is worked out at first; ends are tried when no other start can be better.
        """
        if not text:
            return []
        rows = [words(x) for x in text.split("\n")]
        w = [x for row in rows for x in row]
        grams = list(zip(w, w[1:]))
        hits: dict[int, int] = {}
        for g in self.by_bigram.keys() & set(grams):
            for t in self.by_bigram[g]:
                hits[t] = hits.get(t, 0) + 1
        heap = [x for t, n in hits.items() if n >= self.low * self.sizes[t] - 1e-9 for x in self._starts(t, grams)]
        heapq.heapify(heap)
        used, ends, out = bytearray(len(w)), [], []
        while heap:
            notice, score, n, i, name, k, t = heapq.heappop(heap)
            free = used.find(1, i)
            free = len(w) if free < 0 else free
            if n and i + n <= free:
                used[i:i + n] = b"\1" * n
                ends = ends or list(accumulate(map(len, rows)))
                first = bisect_right(ends, i)
                out.append((i, (name, first, bisect_right(ends, i + n - 1) - first + 1, round(-score, 6))))
            elif i < free:
                best = self._best_end(t, grams, i, free)
                if best:
                    heapq.heappush(heap, (notice, *best, i, name, k, t))
        return [x for _, x in sorted(out)]

    def _starts(self, t: int, grams: list[tuple[str, str]]) -> Iterator[tuple]:
        """Entries without an end yet for the places where a stretch like template ``t`` may start, with a bound of its Dice."""
        size, name, k, own = self.known[t]
        foreign_most = size * (2 / self.threshold - 2) + 1e-9
        inside: dict[tuple[str, str], int] = {}
        foreign = shared = lo = hi = 0
        for i, start in enumerate(grams):
            if start not in own:
                continue
            for g in grams[lo:min(i, hi)]:
                inside[g] -= 1
                if not inside[g]:
                    del inside[g]
                    shared, foreign = (shared - 1, foreign) if g in own else (shared, foreign - 1)
            lo, hi = i, max(i, hi)
            while hi < len(grams):
                g = grams[hi]
                if g not in inside:
                    if g in own:
                        shared += 1
                    elif foreign + 1 > foreign_most:
                        break
                    else:
                        foreign += 1
                inside[g] = inside.get(g, 0) + 1
                hi += 1
            if 2 * shared >= self.threshold * (shared + size) - 1e-9:
                yield k >= 0, -2 * shared / (shared + size), 0, i, name, k, t

    def _best_end(self, t: int, grams: list[tuple[str, str]], i: int, free: int) -> tuple[float, int] | None:
        """Least (-Dice, words) of the stretches from word ``i`` on that end before word ``free``."""
        size, _, _, own = self.known[t]
        foreign_most = size * (2 / self.threshold - 2) + 1e-9
        seen: set[tuple[str, str]] = set()
        shared, best = 0, None
        for j in range(i, free - 1):
            g = grams[j]
            if g in seen:
                if g == grams[i]:
                    break
                continue
            seen.add(g)
            if g in own:
                shared += 1
                if 2 * shared >= self.threshold * (len(seen) + size) - 1e-9:
                    new = (-2 * shared / (len(seen) + size), j - i + 2)
                    best = new if best is None else min(best, new)
            elif len(seen) - shared > foreign_most:
                break
        return best

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(licence, first line, number of lines, Dice) of every notice by whole lines: runs of up to SPAN lines, each line used once, best first."""
        if not text:
            return []
        rows = [words(x) for x in text.split("\n")]
        known = [sum(g in self.by_bigram for g in zip(w, w[1:])) for w in rows]
        found = []
        for i, w in enumerate(rows):
            if not known[i]:  # a notice starts with a line that shares a bigram with some template
                continue
            run: list[str] = []
            for k in range(i, min(i + SPAN, len(rows))):
                run = run + rows[k]
                if len(run) > 4 * self.longest + SPAN:  # sets of repeated bigrams are smaller than runs of words
                    grams = bigrams(run)
                    if len(grams) > self.longest:
                        break
                if rows[k] and known[k]:
                    best = self.best(bigrams(run))
                    if best:
                        found.append((-best[0], k - i + 1, i, best[1]))
        out, used = [], set()
        for score, n, i, name in sorted(found):
            if not used.intersection(range(i, i + n)):
                used.update(range(i, i + n))
                out.append((name, i, n, round(-score, 6)))
        return sorted(out, key=lambda x: x[1])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id and notices (licence, line, n_lines, dice), in order of the text.

    A notice may be part of a line or spread over any number of lines. A null or empty text has no notices; ids and repeated rows are passed on one by one; whole texts of any length are
    scanned; extra columns are not read; an empty table gives no rows.
    """
    @F.pandas_udf("array<struct<licence:string,line:int,n_lines:int,dice:double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(threshold, texts=whole_texts())
        for s in parts:
            yield pd.Series([[dict(zip(("licence", "line", "n_lines", "dice"), x)) for x in matcher.find(t)] for t in s], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("notices"))
