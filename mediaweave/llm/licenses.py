"""8. License scans by winnowed fingerprints and banded alignment.

Templates and texts are words; the smallest hash of K-grams in every window is kept. An inverted index of the
templates' fingerprints gives each text its candidates, by template and diagonal. A candidate's stretch of the text
is aligned with the template by edit distance over words in a band around the diagonal. The share of the template's
words that are matched in order is its coverage; the span is from its first matched word to the last. The words that
tell licenses apart (versions, Lesser, Affero, NC and the like) must be those of the template, no more and no fewer.

Defined results: a null text, like one without words, has no matches; of overlapping matches the one with more
matched words stays, then the shorter one, ties by the template's order; repeated rows get equal results; an empty table gives an empty
result. Other columns pass through find_licenses(), but one that has the name of a result is replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.common import map_rows, table

def _gnu(kind: str, version: str) -> tuple[str, ...]:
    """The notices of a license of the GNU family: kind is what stands before General."""
    name = f"GNU {kind} General Public License".replace("  ", " ")
    thing = "program" if kind in ("", "Affero") else "library"
    return (
        f"This work is licensed under the {name}, version {version}.",
        f"Licensed under the {name}, version {version}.",
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name}, version {version}, as published by the Free Software Foundation.",
    )


def _creative_commons(short: str, long: str, version: str) -> tuple[str, ...]:
    port = {"3.0": "Unported", "4.0": "International"}[version]
    return (f"Licensed under CC {short} {version}.", f"This work is licensed under a Creative Commons {long} {version} {port} License.")


_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_CLAUSES = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))

# Notices by which public licenses are named and the best known short license texts.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": _gnu("", "3"),
    "GPL-2.0": _gnu("", "2"),
    "LGPL-3.0": _gnu("Lesser", "3"),
    "LGPL-2.1": _gnu("Lesser", "2.1"),
    "LGPL-2.0": _gnu("Library", "2"),
    "AGPL-3.0": _gnu("Affero", "3"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", f"{_BSD}: {_BSD_CLAUSES} {_BSD_NAMES}", f"{_BSD}: {_BSD_CLAUSES} {_BSD_NAMES} {_BSD_WARRANTY}"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", f"{_BSD}: {_BSD_CLAUSES} {_BSD_WARRANTY}"),
    "BSD-4-Clause": ("Released under the BSD 4-Clause License.", f"{_BSD}: {_BSD_CLAUSES} {_BSD_ADVERTISING} {_BSD_NAMES}"),
    "BSD": (_BSD,),  # alone it does not tell how many clauses follow
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    **{f"CC-{short}-{version}": _creative_commons(short, long if version == "4.0" else long.replace("Derivatives", "Derivs"), version) for version in ("4.0", "3.0") for short, long in _CC},
    "CC0-1.0": ("Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0 Universal."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "All rights reserved": ("All rights reserved. Do not distribute.", "All rights reserved."),
}

WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"v?([0-9]{1,2}(?:\.[0-9]+)*?)(?:\.0)*")
#: Words that tell licenses apart, as do the version numbers of a template that has one and a library before General.
TELLING = frozenset("lesser affero noncommercial commercial nc noderivatives noderivs derivatives derivs nd sharealike alike sa endorse advertising".split())
K, WINDOW = 3, 2
BAND, COVERAGE = 8, 0.85
RESULTS = "license string, coverage double, first_word long, last_word long, start long, end long"


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m[0], m.span()) for m in WORD.finditer(text.lower())]
    return [version(w) or w for w, _ in found], [s for _, s in found]


def version(word: str) -> str | None:
    found = NUMBER.fullmatch(word) if word[0] in "v0123456789" else None
    return found[1] if found else None


def telling(words: list[str], numbers: bool) -> list[str]:
    """The words that tell licenses apart, in turn."""
    out = []
    for word, then in zip(words, [*words[1:], ""], strict=True):
        if word in TELLING or word == "library" and then == "general":
            out.append(word)
        elif numbers and (found := version(word)):
            out.append(found)
    return out


def kept_grams(words: list[str]) -> dict[int, int]:
    """Places of the winnowed K-grams with their hashes; a text of fewer words is one gram."""
    if len(words) < K:
        return {0: xxhash.xxh3_64_intdigest(" ".join(words).encode())} if words else {}
    hashes = [xxhash.xxh3_64_intdigest(" ".join(words[i : i + K]).encode()) for i in range(len(words) - K + 1)]
    out = {}
    for i in range(max(1, len(hashes) - WINDOW + 1)):
        at = min(range(i, min(i + WINDOW, len(hashes))), key=lambda j: (hashes[j], -j))
        out[at] = hashes[at]
    return out


@cache
def index() -> tuple[list[tuple[str, list[str], bool, list[str]]], dict[int, list[tuple[int, int]]], frozenset[str]]:
    """Templates (name, words, whether they have a version, what tells them apart), inverted index of their fingerprints and the words that stand in them."""
    templates = []
    for name, texts in TEMPLATES.items():
        for words in (words_of(text)[0] for text in texts):
            templates.append((name, words, numbers := any(map(version, words)), telling(words, numbers)))
    grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for t, (_, words, _, _) in enumerate(templates):
        for at, h in kept_grams(words).items():
            grams[h].append((t, at))
    return templates, dict(grams), frozenset(w for _, words, _, _ in templates for w in words)


def align(text: list[str], template: list[str], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence within a band of the diagonal, of equals the one that starts nearest to it: matched
    words, first and last matched word of the text. shift: the place in the text of the template's first word."""
    better = lambda x: (x[0], -abs(x[1] - shift))
    best: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        now: dict[int, tuple[int, int, int]] = {}
        left = (0, -1, -1)
        for j in range(max(0, i + shift - band), min(len(text), i + shift + band + 1)):
            above, before = best.get(j, (0, -1, -1)), best.get(j - 1, (0, -1, -1))
            most = max(left, above, key=better)
            if text[j] == word:
                most = max(most, (before[0] + 1, before[1] if before[0] else j, j), key=better)
            now[j] = left = most
        best = now
    return max(best.values(), default=(0, -1, -1), key=better)


def matches(text: str, least: float = COVERAGE) -> list[tuple]:
    templates, grams, known = index()
    words, spans = words_of(text)
    likely = np.flatnonzero(np.fromiter((w in known for w in words), bool, len(words)))
    found, seen = [], set()
    starts = likely[:-2][(likely[2:] - likely[:-2]) == 2] if len(likely) > 2 else []
    for p in map(int, starts):
        for t, q in grams.get(xxhash.xxh3_64_intdigest(" ".join(words[p : p + K]).encode()), ()):
            name, template, numbers, apart = templates[t]
            if (t, p - q) in seen:
                continue
            seen.add((t, p - q))
            n, first, last = align(words, template, p - q)
            if n >= least * len(template) and telling(words[first : last + 1], numbers) == apart:
                found.append((-n, last - first, t, first, last, name, n / len(template)))
    out = []
    for _, _, _, first, last, name, coverage in sorted(found):
        if all(last < x[2] or first > x[3] for x in out):
            out.append((name, coverage, first, last, spans[first][0], spans[last][1]))
    return sorted(out, key=lambda x: x[2])


def _find(batches, names: list[str], out: list[str], least: float):
    for batch in batches:
        rows, of = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = matches(text, least) if text else []
            rows += found
            of += [i] * len(found)
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.float64()] + [pa.int64()] * 4
        arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of, pa.int64())) for c in names), *arrays], names=out)


def find_licenses(docs: DataFrame, least: float = COVERAGE) -> DataFrame:
    """docs: text. One row a match: the columns of docs, license, coverage, first_word and last_word (numbers of words),
    start and end (code points, end exclusive)."""
    return map_rows(docs, "text", partial(_find, least=least), RESULTS)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.withColumn("coverage", F.round("coverage", 6))
