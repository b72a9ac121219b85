"""License scans by winnowed fingerprints and banded alignment (operator 6)."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, types as T

from sievemill.llm.common import documents, map_texts

#: Words in a fingerprint; fingerprints in a window, of which the least is kept; half the width of the band.
GRAM, WINDOW, BAND = 3, 3, 8
#: The share of a template's words that must match; notices of under SHORT words must match whole.
MIN_COVERAGE, SHORT = 0.8, 16
_TOKEN = re.compile(r"[^\W_]+")

# Wordings of public licenses and of the notices that name them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "GPL-2.0": (
        "licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "AGPL-3.0": (
        "licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "LGPL-3.0": (
        "licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "LGPL-2.1": (
        "licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following:",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty.",
        "Licensed under CC0 1.0.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
}
# Names of public licenses in notices.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Zlib": ("zlib License",),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"),
    "Unlicense": ("Unlicense",),
}
TEMPLATES = {
    name: (*texts, *(f"under the {of}{x}" for x in NAMES.get(name, ()) for of in ("", "terms of the ")), f"SPDX-License-Identifier: {name}")
    for name, texts in TEMPLATES.items()
}

#: What tells a license from those of like wording: words that a finding must hold (of notices of under SHORT words, all), and
#: words that it must not.
MARKS: dict[str, tuple[str, str]] = {
    "GPL-3.0": ("3", "lesser affero"), "GPL-2.0": ("2", "lesser affero"), "AGPL-3.0": ("affero 3", "lesser"), "LGPL-3.0": ("lesser 3", "affero"),
    "LGPL-2.1": ("lesser 2 1", "affero"), "BSD-3-Clause": ("3", ""), "CC-BY-4.0": ("", "nc sa nd noncommercial sharealike noderivatives"),
    "CC-BY-SA-4.0": ("", "nc nd noncommercial noderivatives"), "CC-BY-NC-4.0": ("", "sa nd sharealike noderivatives"),
    "MPL-2.0": ("2", ""), "Apache-2.0": ("license", ""), "EPL-2.0": ("eclipse 2", ""),
}
#: Templates that begin so match whole, so they need no marks.
_TAG = "SPDX"


@dataclass
class Index:
    """Templates as word numbers, and where each of their kept fingerprints occurs."""

    names: list[str]
    words: list[list[int]]
    numbers: dict[str, int]
    grams: np.ndarray
    places: list[list[tuple[int, int]]]
    needs: list[set[int]]
    never: list[set[int]]

    def find(self, text: str) -> list[dict]:
        """The templates that occur in a text: license, coverage, start and end (code points), in order of start."""
        number = self.numbers
        ids = np.array([number.get(w, 0) for w in map(str.lower, _TOKEN.findall(text))], dtype=np.int64)
        if len(ids) < GRAM:
            return []
        codes = _codes(ids, len(number) + 1)
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        hits = np.flatnonzero(self.grams[at] == codes)
        if not len(hits):
            return []
        diagonals: dict[int, set[int]] = {}
        for k in hits.tolist():
            for template, place in self.places[at[k]]:
                diagonals.setdefault(template, set()).add(k - place)
        spots = None
        found = []
        for template, starts in sorted(diagonals.items()):
            low = None
            bands = []
            for d in sorted(starts):  # diagonals within a band of each other belong to one alignment
                if low is None or d - low > BAND:
                    low = d
                    bands.append([d, d])
                bands[-1][1] = d
            size = len(self.words[template])
            least = size if size < SHORT else MIN_COVERAGE * size
            for low, high in bands:
                begin = max(0, low - BAND)
                part = ids[begin : high + BAND + size + 1].copy()  # all words that the band can meet
                if not self.needs[template].issubset(part.tolist()):
                    continue
                while got := align(self.words[template], part, low - BAND - begin, high + BAND - begin):
                    matched, first, last = got
                    if matched < least:
                        break
                    inside = set(part[first : last + 1].tolist())
                    part[first : last + 1] = 0  # the notice may stand in the band again
                    if not self.needs[template] <= inside or self.never[template] & inside:
                        continue
                    spots = spots or [m.span() for m in _TOKEN.finditer(text)]
                    span = {"start": spots[begin + first][0], "end": spots[begin + last][1]}
                    found.append({"license": self.names[template], "coverage": matched / size, "words": matched} | span)
        return _largest(found)


def _largest(found: list[dict]) -> list[dict]:
    """Of findings that overlap, the one with most matched words (ties: the higher coverage, then the first)."""
    out: list[dict] = []  # in the order of the text
    starts: list[int] = []
    for f in sorted(found, key=lambda f: (-f["words"], -f["coverage"], f["start"], f["license"])):
        k = bisect_left(starts, f["start"])
        if (k == 0 or out[k - 1]["end"] <= f["start"]) and (k == len(out) or f["end"] <= out[k]["start"]):
            starts.insert(k, f["start"])
            out.insert(k, f)
    return out


def _codes(ids: np.ndarray, base: int) -> np.ndarray:
    """A number for each run of GRAM words; -1 where one isn't a word of any template."""
    count = len(ids) - GRAM + 1
    code, known = np.zeros(max(0, count), dtype=np.int64), np.ones(max(0, count), dtype=bool)
    for k in range(GRAM):
        part = ids[k : k + count]
        code = code * base + part
        known &= part > 0
    return np.where(known, code, -1)


def winnow(codes: np.ndarray) -> list[int]:
    """The places of the least hash in each window of WINDOW fingerprints (the last of equal ones)."""
    hashed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    kept: dict[int, None] = {}
    for k in range(max(1, len(codes) - WINDOW + 1)):
        window = hashed[k : k + WINDOW]
        if len(window):
            kept[k + len(window) - 1 - int(window[::-1].argmin())] = None
    return list(kept)


def build(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> Index:
    names, rows, numbers, needs, never = [], [], {}, [], []
    for name, texts in templates.items():
        for text in texts:
            names.append(name)
            rows.append([numbers.setdefault(w, len(numbers) + 1) for w in map(str.lower, _TOKEN.findall(text))])
            marks, others = ("", "") if text.startswith(_TAG) else MARKS.get(name, ("", ""))
            for to, listed in ((needs, marks), (never, others)):
                to.append({numbers.setdefault(w, len(numbers) + 1) for w in listed.split()})
            if len(rows[-1]) < SHORT:
                needs[-1] = set(rows[-1])
    places: dict[int, list[tuple[int, int]]] = {}
    for t, row in enumerate(rows):
        codes = _codes(np.array(row, dtype=np.int64), len(numbers) + 1)
        for k in winnow(codes):
            places.setdefault(int(codes[k]), []).append((t, k))
    grams = sorted(places)
    return Index(names, rows, numbers, np.array(grams, dtype=np.int64), [places[g] for g in grams], needs, never)


def align(template: list[int], words: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """Local alignment of the template with words on the diagonals low to high (word minus template position).

    A matching word counts 2, a different one or a gap -1.  Gives the number of matched words of the best alignment
    (ties: the first end) and the positions of its first and last word.
    """
    width = high - low + 1
    best = None
    above = [(0, 0, -1)] * (width + 1)  # score, matched, first, by diagonal, of the template's last word
    for i, t in enumerate(template):
        row = [(0, 0, -1)] * (width + 1)
        left = (0, 0, -1)
        for d in range(width):
            j = i + low + d
            if not 0 <= j < len(words):
                left = (0, 0, -1)
                continue
            s, m, f = above[d]
            same = bool(t) and words[j] == t
            cell = (s + 2, m + 1, j if f < 0 else f) if same else (s - 1, m, f)
            up = above[d + 1]
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, left[1], left[2])
            if cell[0] <= 0:
                cell = (0, 0, -1)
            row[d] = left = cell
            if same and (best is None or cell[0] > best[0]):
                best = (cell[0], cell[1], cell[2], j)
        above = row
    return best and (best[1], best[2], best[3])


FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("words", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)


def scan_licenses(df: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with licenses: an array of (license, coverage, words, start, end), empty where a text names none.

    Spans are code points of the whole text; letter case, punctuation and white space don't count.  Null and empty
    texts have none; repeated rows get the same; a column of this name is replaced.
    """
    index = build(templates)
    return map_texts(df, lambda texts: {"licenses": [index.find(x) for x in texts]}, [T.StructField("licenses", FOUND)], text, keep)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
