"""Licence scans: Dice coefficient over word bigrams against licence templates, in DataFrame functions.

The passages of a text are its lines, its paragraphs of several lines and the sentences of lines that hold several; they
are compared with notices and their longer sentences. The whole text is compared with the full texts of licences. A
passage and a template are lower-cased, every stretch of other characters than letters and digits is a blank, and their
sets of word bigrams are compared: 2 |A and B| / (|A| + |B|). What is pruned can't reach the cutoff c:

* A match shares c / (2 - c) of a template's bigrams at least. ``marks`` are words that touch more than the rest of the
  bigrams of every template, so a text or passage without any of them matches none; most texts end there.
* A passage whose number of words no template can match is dropped before its bigrams are made.
* A template is compared only if both sizes allow the cutoff.

There is no shuffle, and a row's work is bounded by its text.

Nulls: a null text has no passages. Ties between templates go to the first in the list. Passages of one word have no
bigrams and match nothing. Repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from importlib import resources
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence statements as they are put above or below a text.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Full texts: the files of this folder of the package, as Debian has them, and their names.
FOLDER = "licences"
FILES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
SENTENCE = r"(?<=[.!?;:])\s+"
PARAGRAPH = r"\n[ \t\r]*\n"
COMMON = set("the and for that this with any from are not you may which such other under will have been must shall when each its all".split())


def full_texts(folder: str | None = None) -> list[tuple[str, str]]:
    """The texts of licences by the names in ``FILES``, those that come with the package or those of a folder that has the
    files with or without ``.txt``. One that is not there is an error: without it a licence would seem not to be found."""
    own = resources.files(__package__) / FOLDER if folder is None else Path(folder)
    found = {f: next((p for p in (own / f"{f}.txt", own / f) if p.is_file()), None) for f in FILES}
    if missing := [f for f, p in found.items() if p is None]:
        raise FileNotFoundError(f"{own} has no {', '.join(missing)}")
    return [(name, found[f].read_bytes().decode("utf-8", "replace")) for f, name in FILES.items()]


def expanded(templates: list[tuple[str, str]], fewest: int = 8) -> list[tuple[str, str]]:
    """The templates, and after them the sentences of ``fewest`` words or more of those that hold several."""
    parts = [(name, x) for name, t in templates if len(p := re.split(SENTENCE, t)) > 1 for x in p if len(words(x)) >= fewest]
    return list(dict.fromkeys([*templates, *parts]))


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order."""
    w = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def marks(sets: list[list[str]], cutoff: float) -> list[str]:
    """Words that touch so many bigrams of each set that none can reach the cutoff without them, rarer kinds of words first."""
    chosen: set[str] = set()
    for s in sorted(sets, key=len):
        need = len(s) * (1 - cutoff / (2 - cutoff))
        pairs = [set(b.split(" ")) for b in s]
        while sum(bool(p & chosen) for p in pairs) <= need:
            left = Counter(w for p in pairs if not p & chosen for w in p)
            chosen.add(max(left, key=lambda w: (len(w) > 2 and w not in COMMON, left[w] * min(len(w), 9), w)))
    return sorted(chosen)


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1))))


def _hits(text: Column, passages: Column, templates: list[tuple[str, str]], cutoff: float) -> Column:
    """(license, template, dice, passage) of the passages of a text that reach the cutoff with one of the templates."""
    sets = [(i, s) for i, (_, t) in enumerate(templates) if (s := bigrams(t))]
    low, high = cutoff / (2 - cutoff), (2 - cutoff) / cutoff
    fewest, most = min(len(s) for _, s in sets) * low, max(len(s) for _, s in sets) * high
    table = F.array(*[F.struct(F.lit(templates[i][0]).alias("license"), F.lit(i).alias("template"), F.array(*map(F.lit, s)).alias("set")) for i, s in sets])
    by_letter: dict[str, list[str]] = {}
    for w in marks([s for _, s in sets], cutoff):
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
    mark = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + r")(?![\p{L}\p{N}])"

    passages = F.when(F.lower(text).rlike(mark), passages).otherwise(F.array().cast("array<string>"))
    marked = F.filter(passages, lambda p: (F.length(p) >= 3) & F.lower(p).rlike(mark))
    split = F.transform(marked, lambda p: F.struct(p.alias("p"), F.filter(F.split(F.lower(p), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w")))
    long = F.filter(split, lambda x: (F.size(x["w"]) - 1 >= fewest))
    sized = F.filter(F.transform(long, lambda x: F.struct(x["p"].alias("p"), _bigrams(x["w"]).alias("b"))), lambda x: (F.size(x["b"]) >= fewest) & (F.size(x["b"]) <= most))

    def best(x: Column) -> Column:
        possible = F.filter(table, lambda t: (F.size(x["b"]) >= F.size(t["set"]) * low) & (F.size(x["b"]) <= F.size(t["set"]) * high))
        scored = F.transform(possible, lambda t: F.struct((2.0 * F.size(F.array_intersect(x["b"], t["set"])) / (F.size(x["b"]) + F.size(t["set"]))).alias("dice"), (-t["template"]).alias("o"), t["license"].alias("license"), x["p"].alias("passage")))
        return F.array_max(scored)

    hits = F.filter(F.transform(sized, best), lambda h: h["dice"] >= cutoff)
    return F.transform(hits, lambda h: F.struct(h["license"].alias("license"), (-h["o"]).alias("template"), h["dice"].alias("dice"), h["passage"].alias("passage")))


def scan(docs: DataFrame, text_col: str = "text", cutoff: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES, full: list[tuple[str, str]] = (), name: str = "licenses") -> DataFrame:
    """``docs`` with the column ``name``: array of (license, template, dice, passage), lines first, then paragraphs,
    sentences and the whole text; a hit inside a longer passage that is as near to a template is left out. ``full`` are the texts of whole licences; ``template`` counts them apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.filter(F.split(x, SENTENCE), lambda p: p != x)))
    paragraphs = F.filter(F.split(text, PARAGRAPH), lambda p: p.contains("\n"))
    found = [_hits(text, F.concat(lines, paragraphs, sentences), templates, cutoff)]
    if full:
        found.append(_hits(text, F.array(text), list(full), cutoff))
    every = docs.withColumn(name, F.concat(*found))
    inside = lambda h: F.exists(name, lambda g: g["passage"].contains(h["passage"]) & (g["passage"] != h["passage"]) & (g["dice"] >= h["dice"]))
    return every.withColumn(name, F.filter(name, lambda h: ~inside(h)))
