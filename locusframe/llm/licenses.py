"""License scans: MinHash bands over text windows retrieve templates, containment verifies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Words, mixed, slices

# Texts and notices by which works name their license, each with the words that tell it
# apart from its relatives and so must all be there. Where a text is shared by versions it names the family.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software.", ()),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ()),
    ("MIT", "under the MIT License", ("mit license",)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
     "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
     "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("apache license",)),
    ("Apache-2.0", "under the Apache License, Version 2.0", ("apache license", "2 0")),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution.", ()),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ()),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
     "without specific prior written permission.", ()),
    ("BSD-2-Clause", "under the BSD 2-Clause License", ("bsd 2",)),
    ("BSD-3-Clause", "under the BSD 3-Clause License", ("bsd 3",)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
     "notice and this permission notice appear in all copies.", ()),
    ("ISC", "under the ISC License", ("isc license",)),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
     "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ()),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
     "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ()),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software",)),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
     "Foundation", ("gnu general",)),
    ("GPL-2.0", "the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
     "version", ("gnu general", "version 2")),
    ("GPL-3.0", "the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
     "version", ("gnu general", "version 3")),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2", ("gnu general", "version 2")),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3", ("gnu general", "version 3")),
    ("LGPL-2.1", "the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
     "any later version", ("gnu lesser", "2 1")),
    ("LGPL-3.0", "the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version", ("gnu lesser", "version 3")),
    ("AGPL-3.0", "the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version", ("gnu affero", "version 3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
     "obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla public",)),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public", "2 0")),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ("eclipse public", "2 0")),
    ("CC0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide "
     "under copyright law", ()),
    ("CC0-1.0", "under CC0 1.0 Universal", ("cc0 1",)),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("attribution 4",)),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike",)),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial", "noncommercial 4")),
    ("CC-BY-NC-SA-4.0", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ("noncommercial sharealike",)),
    ("CC-BY-4.0", "licensed under CC BY 4.0", ("by 4",)),
    ("CC-BY-SA-4.0", "licensed under CC BY-SA 4.0", ("by sa", "sa 4")),
    ("CC-BY-NC-4.0", "licensed under CC BY-NC 4.0", ("by nc", "nc 4")),
]
#: Words of a shingle, MinHash values of one row a band, the least containment of a match, and how far
#: a match may reach: STRETCH shingles for each of the template's, and SLACK more. An occurrence lies
#: whole in a window of 1.5 W shingles, W the power of two next to its reach, so its similarity with the
#: template of m shingles is J >= 0.8 m / (1.5 W + 0.2 m), 0.2 at the least; of 48 bands of one value
#: one agrees with probability 1 - (1 - J)**48, over 0.9999.
SHINGLE, BANDS, CONTAINED, STRETCH, SLACK = 2, 48, 0.8, 1.25, 4
#: Shingles of the smallest block of which windows are made.
BLOCK = 4
_ODD = np.random.default_rng(43).integers(0, 2**32, BANDS).astype(np.uint32) | np.uint32(1)
_MOST = np.uint32(0xFFFFFFFF)
#: Words here: runs of ASCII letters, A-Z in lower case, digits, and bytes beyond ASCII.
_TABLE = np.arange(256, dtype=np.uint64) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_TABLE[[i for i in range(128) if not chr(i).isalnum()]] = 0


def _pairs(w: Words) -> np.ndarray:
    """Hashes of each two consecutive words, the last word with none."""
    if len(w.hash) < SHINGLE:
        return np.zeros(0, np.uint64)
    return mixed(w.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:])


class Template:
    """A template's shingles, those that must be there, and how far an occurrence may reach."""

    def __init__(self, number: int, license: str, text: str, must: tuple[str, ...]):
        h = _pairs(Words([text.encode()], _TABLE))
        self.name, self.license, self.own = f"{license}#{number}", license, np.unique(h)
        self.must = np.unique(np.concatenate([np.zeros(0, np.uint64), *[_pairs(Words([m.encode()], _TABLE)) for m in must]]))
        self.need = int(np.ceil(CONTAINED * len(self.own) - 1e-9))
        self.reach = int(STRETCH * len(h)) + SLACK
        self.level = max(0, int(np.ceil(np.log2(self.reach / (2 * BLOCK)))))
        self.mins = [int(((self.own >> np.uint64(32)).astype(np.uint32) * odd).min()) for odd in _ODD] if len(h) else []

    def occurrences(self, place: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        """(first, last, share) of the matches among shingles h at rising places.

        From left to right: the shortest run, within the reach, that has the needed share of the
        template's shingles and all that must be there, longer by those of the template that follow and
        are new; without leading shingles that come again in it. The next match begins after it.
        """
        out, i, n = [], 0, len(place)
        at, token = place.tolist(), h.tolist()
        must = set(self.must.tolist())
        while i < n:
            seen, j = set(), i
            while j < n and at[j] - at[i] < self.reach:
                if len(seen) >= self.need and must <= seen and token[j] in seen:
                    break
                seen.add(token[j])
                j += 1
            if len(seen) < self.need or not must <= seen:
                i += 1
                continue
            while token[i] in token[i + 1 : j]:
                i += 1
            out.append((at[i], at[j - 1], len(seen) / len(self.own)))
            i = j
        return out


class Scanner:
    """Templates with their bands, by the level of their windows."""

    def __init__(self, templates: list[tuple[str, str, tuple[str, ...]]] | None = None):
        found = [Template(i, *t) for i, t in enumerate(TEMPLATES if templates is None else templates)]
        self.templates = [t for t in found if len(t.own)]
        self.levels = sorted({t.level for t in self.templates})
        self.bands = {(lv, b): {} for lv in self.levels for b in range(BANDS)}
        for i, t in enumerate(self.templates):
            for b, v in enumerate(t.mins):
                self.bands[t.level, b].setdefault(v, []).append(i)

    def retrieved(self, h: np.ndarray, doc: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """For (document, template) the windows, as ranges of shingles, that share a band with it.

        Windows are three blocks long and begin at every block; blocks are aligned with the documents,
        and those of a level are made of two of the level below.
        """
        x = (h >> np.uint64(32)).astype(np.uint32)
        begin = np.r_[0, np.flatnonzero(np.diff(doc)) + 1]
        inside = np.arange(len(h)) - np.repeat(begin, np.diff(np.r_[begin, len(h)]))
        starts = np.flatnonzero(inside % BLOCK == 0)
        grids = []  # of each level: where blocks start (shingles), which of the level below they join, and whether the next two are of the document
        below = np.arange(len(starts))
        for lv in range(max(self.levels, default=-1) + 1):
            if lv:
                pick = np.flatnonzero(inside[starts] % (BLOCK << lv) == 0)
                below, starts = pick, starts[pick]
            d = doc[starts]
            grids.append((starts, below, np.r_[d[1:] == d[:-1], False], np.r_[d[2:] == d[:-2], [False] * min(2, len(d))]))
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for b, odd in enumerate(_ODD):
            mins = np.minimum.reduceat(x * odd, grids[0][0])
            for lv, (starts, below, next1, next2) in enumerate(grids):
                if lv:
                    mins = np.minimum.reduceat(mins, below)
                table = self.bands.get((lv, b))
                if not table:
                    continue
                window = np.minimum(mins, np.where(next1, np.r_[mins[1:], _MOST], _MOST))
                window = np.minimum(window, np.where(next2, np.r_[mins[2:], [_MOST] * min(2, len(mins))], _MOST))
                for i in np.flatnonzero(np.isin(window, np.array(list(table), np.uint32))).tolist():
                    for t in table.get(int(window[i]), ()):
                        out.setdefault((int(doc[starts[i]]), t), []).append((int(starts[i]), int(starts[i]) + 3 * (BLOCK << lv)))
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, str, float, int, int]]]:
        """(template, license, containment, first character, end) of the matches in each text, in order."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        out: list[list] = [[] for _ in raw]
        for a, b in slices(raw):
            w = Words(raw[a:b], _TABLE)
            owner = np.repeat(np.arange(b - a), np.diff(w.first))
            h = _pairs(w)
            word = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, np.int64)
            if not len(word):
                continue
            h, doc = h[word], owner[word]
            ends = np.r_[np.searchsorted(doc, np.arange(b - a)), len(doc)]
            offset = np.cumsum([1, *[len(t) + 1 for t in raw[a:b]]])
            for (d, t), windows in self.retrieved(h, doc).items():
                template = self.templates[t]
                near = np.unique(np.concatenate([np.arange(lo, min(hi, ends[d + 1])) for lo, hi in windows]))
                near = near[np.isin(h[near], template.own)]
                if len(near) < template.need:
                    continue
                for first, last, share in template.occurrences(near, h[near]):
                    text, o = raw[a + d], offset[d]
                    chars = lambda p: len(text[: p - o].decode("utf-8", "surrogatepass"))  # noqa: E731, B023
                    out[a + d].append((template.name, template.license, share, chars(w.start[word[first]]), chars(w.end[word[last] + 1])))
        return [sorted(x, key=lambda m: (m[3], m[0])) for x in out]


def scan(docs: DataFrame, templates: list[tuple[str, str, tuple[str, ...]]] | None = None) -> DataFrame:
    """Columns of `docs` and _matches: array of (template, license, containment, start, end).

    Windows of the whole text, in words (`_TABLE`), overlap so that each occurrence of a template lies
    in one of them. MinHash values of a window's word pairs are looked up in the templates' bands; a
    template that shares one is verified by the exact share of its shingles within its reach, and by
    those that must be there. Every occurrence is reported once. The templates are a fixed list, or
    given ones (license, text, words that must be there), held by each task.

    Null, empty and one-word texts: no matches. Repeated rows give equal rows; empty table: no rows.
    A column of the name _matches is replaced.
    """
    scanner = Scanner(templates)

    @F.pandas_udf("array<struct<template:string,license:string,containment:double,start:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("template", "license", "containment", "start", "end"), m)) for m in found] for found in scanner.scan(list(texts))])

    return docs.withColumn("_matches", find("text"))
