"""License scans (operator 1): sparse TF-IDF cosine to templates, then inheritance along directories.

Word windows of half to twice the length of each short licence notice slide over every whole text and are compared
with it by the cosine of TF-IDF vectors; line breaks do not matter. The best one at ``header_min`` or more is the
document's own licence; an SPDX line names it outright, whatever its id. A notice that is denied ("not licensed under") is
no notice. A document whose whole text reaches ``file_min`` against the text of a whole
licence (``licence_texts``) and holds most of its words, or that holds the opening of a Creative Commons legal code, is a licence file and speaks for
itself and its directory: documents without an own licence inherit from the nearest ancestor directory (their own first)
that has a licence file. A notice speaks for its own document only.

Document frequencies of the template words are counted over all documents; a word outside the templates
weighs like a word found in one document. The bounds that skip windows and templates are exact: a cosine of
``header_min`` needs one of the template's heaviest words, those without which the rest of its vector is too short,
and words of the text that make up enough of the template's vector.

Neighbouring licences share most words, so words that tell them apart decide: a window counts for a notice only if it
holds the notice's family name and version and no variant word (affero, lesser, sharealike, nd, clause ...) that the
notice lacks. A GNU or Creative Commons notice without a version has no licence. Without a clause on endorsement, the
BSD conditions are the two-clause licence.

Defined cases: null text has no licence but inherits; null path parts become ``_``; among equal scores
the template first in order wins, among licence files of one directory the best score, then the smallest
id; repeated rows are kept; an empty table gives no rows; columns other than ``doc_id``, ``text`` and those of the
directory are not read, and ``source`` and ``lang`` may be absent.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from kanon.llm.common import map_arrow, written

HEADER_MIN = 0.75
FILE_MIN = 0.6
#: Share of a whole licence (of its squared vector) that the words of a licence file make up; a notice has less.
FILE_HELD = 0.8

def _gnu(kind: str, what: str, version: str) -> list[str]:
    letter = {"Affero ": "A", "": ""}.get(kind, "L")
    return [
        f"This work is licensed under the GNU {kind}General Public License, version {version}.",
        f"Licensed under the GNU {letter}GPL v{version}.",
        f"Licensed under the GNU {letter}GPLv{version}.",
        f"Licensed under the {letter}GPL version {version}.",
        f"Licensed under {letter}GPL version {version} or any later version.",
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
    ]


def _creative_commons(version: str, port: str) -> dict[str, list[str]]:
    kinds = {"": "", "-SA": "-ShareAlike", "-ND": "-NoDerivatives", "-NC": "-NonCommercial", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
    return {f"CC-BY{k}-{version}": [f"Licensed under CC BY{k} {version}.", f"This work is licensed under a Creative Commons Attribution{name} {version} {port} License."] for k, name in kinds.items()}


# Short notices of well-known licences, by SPDX id.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": _gnu("", "program", "3"),
    "GPL-2.0": _gnu("", "program", "2"),
    "GPL-1.0": _gnu("", "program", "1"),
    "AGPL-3.0": _gnu("Affero ", "program", "3"),
    "LGPL-2.1": _gnu("Lesser ", "library", "2.1"),
    "LGPL-3.0": _gnu("Lesser ", "library", "3"),
    "LGPL-2.0": _gnu("Library ", "library", "2"),
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"],
    **_creative_commons("4.0", "International"), **_creative_commons("3.0", "Unported"), **_creative_commons("2.5", "Generic"), **_creative_commons("2.0", "Generic"),
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2.", "Licensed under the European Union Public Licence EUPL, Version 1.2."],
    "EPL-2.0": ["Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "Zlib": ["Released under the zlib license.", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. zlib license"],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0."],
}

# Lengths of the windows, in words of the template.
WINDOW_SHARES = (0.5, 0.75, 1, 1.25, 1.5, 2)

WORD = re.compile(r"[a-z0-9][a-z0-9.]*[a-z0-9]|[a-z0-9]")


def words_of(line: str) -> list[str]:
    return WORD.findall(line.lower())


# Whole licence files, by SPDX id.
TEXTS = {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}

VOCABULARY = frozenset(w for t in [*(t for texts in TEMPLATES.values() for t in texts), *TEXTS.values()] for w in words_of(t))

# Words that name a family (a notice's must be there) and words that name a variant (no others may be).
FAMILIES = {"mit": "mit", "apache": "apache", "bsd": "bsd", "isc": "isc", "mozilla": "mozilla", "mpl": "mozilla", "gnu": "gnu", "gpl": "gnu", "agpl": "gnu", "lgpl": "gnu", "cc": "cc", "creative": "cc", "cc0": "cc0",
            "eupl": "eupl", "epl": "eclipse", "eclipse": "eclipse", "bsl": "boost", "boost": "boost", "unlicense": "unlicense", "unencumbered": "unlicense", "zlib": "zlib"}
VARIANTS = {
    "affero": "affero", "agpl": "affero", "lesser": "lesser", "lgpl": "lesser", "sharealike": "sa", "alike": "sa", "sa": "sa", "noncommercial": "nc", "commercial": "nc",
    "nc": "nc", "noderivatives": "nd", "noderivs": "nd", "derivatives": "nd", "nd": "nd", "clause": "clause",
}
VERSION = re.compile(r"([al]?gpl|mpl)?v?\.?([0-9]+(?:\.[0-9]+)*)")


@lru_cache(1 << 16)
def _decider(word: str) -> tuple[str, str, str]:
    """(family, variant, version) that a word names, "" for none."""
    m = VERSION.fullmatch(word)
    name = (m[1] or "") if m else word
    return FAMILIES.get(name, ""), VARIANTS.get(name, ""), re.sub(r"(\.0)+$", "", m[2]) if m else ""


def deciders(words: list[str]) -> tuple[frozenset[str], frozenset[str]]:
    """Families and versions, and variants, that the words name."""
    found = [_decider(w) for w in words]
    library = {"library"} if any(a == "library" and b == "general" for a, b in zip(words, words[1:])) else set()
    return frozenset({f for f, _, _ in found} | {v for _, _, v in found}) - {""}, frozenset({k for _, k, _ in found} | library) - {""}


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """Documents that hold each template word, and the number of documents; at most one row per word comes back."""

    def run(rows: list[tuple]) -> list[tuple]:
        n: Counter = Counter()
        for (text,) in rows:
            n.update(VOCABULARY.intersection(words_of(text or "")))
        return [*n.items(), ("", len(rows))]

    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])
    counts = {r[0]: r[1] for r in map_arrow(docs.select("text"), run, schema).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counts, counts.pop("", 0)


class Matcher:
    """Template vectors and the exact skipping bound for one set of document frequencies."""

    def __init__(self, df: dict[str, int], n: int, least: float = HEADER_MIN):
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in VOCABULARY}
        self.other = math.log((n + 1) / 2) + 1
        self.least = least
        self.decide: list[tuple[frozenset[str], frozenset[str]]] = []
        self.templates: list[tuple[str, dict[str, float]]] = []
        self.own_needed: list[set[str]] = []
        self.lengths: list[list[int]] = []
        for name, texts in TEMPLATES.items():
            for t in texts:
                v = self._vector(t)
                self.templates.append((name, v))
                self.decide.append(deciders(words_of(t)))
                rest = 1.0
                needed: set[str] = set()
                for w, x in sorted(v.items(), key=lambda kv: (-kv[1], kv[0])):
                    if rest < least * least - 1e-9:
                        break
                    needed.add(w)
                    rest -= x * x
                self.own_needed.append(needed)
                n_words = len(words_of(t))
                self.lengths.append(sorted({max(1, round(n_words * k)) for k in WINDOW_SHARES}))
        self.files = [(name, self._vector(t)) for name, t in TEXTS.items()]

    def _vector(self, text: str) -> dict[str, float]:
        v = {w: (1 + math.log(c)) * self.idf[w] for w, c in Counter(words_of(text)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    def fits(self, k: int, words: list[str]) -> bool:
        """The words name the family, the version and the variant of template ``k``."""
        have, need = deciders(words), self.decide[k]
        return have[0] >= need[0] and have[1] == need[1]

    def best_file(self, words: list[str], held: frozenset[str], file_min: float) -> tuple[float, str | None]:
        """Highest cosine at ``file_min`` or more of a whole text over the whole licences, and its name."""
        could = [(name, t) for name, t in self.files if _mass(t, held) >= max(FILE_HELD, file_min * file_min) - 1e-9]
        if not could:
            return 0.0, None
        v = {w: (1 + math.log(c)) * self.idf.get(w, self.other) for w, c in Counter(words).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        s, name = max(((_dot(v, t) / size, name) for name, t in could), key=lambda x: x[0])
        if s < file_min:
            return 0.0, None
        if name == "GPL-3.0" and "affero" in words[:12]:  # the same text but for the title and one section
            name = "AGPL-3.0"
        if name.startswith("BSD-"):
            name = _bsd(held)
        return s, name

    def slide(self, words: list[str], k: int) -> float:
        """Highest cosine of template ``k`` over the windows of ``words``."""
        top = 0.0
        places = [i for i, w in enumerate(words) if w in self.own_needed[k]]
        for length in self.lengths[k]:
            end = 0
            for n, p in enumerate(places):
                if n and p - places[n - 1] < 2 * length - 1:  # covered by the stretch of an earlier place
                    continue
                last = n
                while last + 1 < len(places) and places[last + 1] - places[last] < 2 * length - 1:
                    last += 1
                start, end = max(0, p - length + 1), min(len(words), places[last] + length)
                top = max(top, self._stretch(words[start:end], length, k))
        return top

    def _stretch(self, words: list[str], length: int, k: int) -> float:
        """Highest cosine over the windows of a stretch of words, which enter and leave one by one; 0 if none is
        enough and fits."""
        count: dict[str, int] = {}
        t, floor = self.templates[k][1], self.least * self.least - 1e-9
        dot = size = top = 0.0
        for i, w in enumerate(words):
            if i >= length:
                out = words[i - length]
                c = count[out]
                count[out] = c - 1
                x = self.idf.get(out, self.other)
                before, after = (1 + math.log(c)) * x, (1 + math.log(c - 1)) * x if c > 1 else 0.0
                size += after * after - before * before
                dot += (after - before) * t.get(out, 0.0)
            c = count.get(w, 0)
            count[w] = c + 1
            x = self.idf.get(w, self.other)
            before, after = (1 + math.log(c)) * x if c else 0.0, (1 + math.log(c + 1)) * x
            size += after * after - before * before
            dot += (after - before) * t.get(w, 0.0)
            if (i >= length - 1 or i == len(words) - 1) and dot > 0 and dot * dot > max(floor, top * top) * size and self.fits(k, words[max(0, i - length + 1) : i + 1]):
                top = dot / math.sqrt(size)
        return min(1.0, round(top, 9))

    def scan(self, text: str | None, header_min: float, file_min: float) -> tuple[str | None, float, str | None, float]:
        """(own licence, its score, licence as a file, its score) of a whole text."""
        text = without_denials(text or "")
        words = words_of(text)
        held = VOCABULARY.intersection(words)
        own: tuple[float, str | None] = (0.0, None)
        floor = self.least * self.least - 1e-9
        for k, (name, t) in enumerate(self.templates):
            if _mass(t, held) >= floor:
                own = max(own, (self.slide(words, k), name), key=lambda x: x[0])
        named_outright = spdx_id(text)
        if named_outright:
            own = (1.0, named_outright)
        whole = legal_code(text, words) or self.best_file(words, held, file_min)
        file = whole if whole[0] else None
        if file:  # a whole licence speaks for itself
            own = file
        mine = own if own[0] >= min(header_min, file_min if own is file else header_min) else (0.0, None)
        named = lambda x: _bsd(held) if x[1] == "BSD-3-Clause" and not named_outright and not _three(words) else x[1]
        return named(mine), mine[0], *((named(whole), whole[0]) if whole[0] >= file_min else (None, 0.0))


SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(*[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)", re.I)
SPDX_SUFFIX = re.compile(r"(-or-later|-only|\+)$", re.I)
DENIED = re.compile(
    r"\b(?:not|never|no longer|n['’]t)\s+(?:\w+\s+){0,2}?(?:licen[sc]ed|released|distributed|available|covered|provided|published)\s+(?:\w+\s+){0,2}?under\b(?:(?!\bbut\b|[.;](?:\s|$)).)*",
    re.I | re.S,
)
LEGAL_CODE = re.compile(r"conditions of this creative commons (attribution(?:-noncommercial)?(?:-noderivatives|-sharealike)?) ([0-9.]+) (?:international|unported|generic) public license")
LEGAL_CODE_WORDS = 300


def spdx_id(text: str) -> str | None:
    """The (first) id of an SPDX line; forms of one version are that version."""
    m = SPDX.search(text)
    return SPDX_SUFFIX.sub("", m[1].rstrip(".")) if m else None


def without_denials(text: str) -> str:
    """``text`` without "not licensed under ..." up to "but" or the end of the sentence."""
    return DENIED.sub(" ", text) if "under" in text.lower() else text


def legal_code(text: str, words: list[str]) -> tuple[float, str] | None:
    """A Creative Commons legal code, known by the sentence that opens it."""
    if len(words) < LEGAL_CODE_WORDS or "creative commons" not in text.lower():
        return None
    m = LEGAL_CODE.search(" ".join(text.lower().split()))
    if m is None:
        return None
    kind = m[1].replace("attribution", "BY").replace("noncommercial", "NC").replace("noderivatives", "ND").replace("sharealike", "SA")
    return 1.0, f"CC-{kind}-{m[2]}"


def _dot(a: dict[str, float], b: dict[str, float]) -> float:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    return sum(x * large[w] for w, x in small.items() if w in large)


def _mass(t: dict[str, float], held: frozenset[str]) -> float:
    """Squared length of the part of a template that the held words make up: no window has a larger squared cosine."""
    return sum(t[w] * t[w] for w in held.intersection(t))


def _bsd(held: frozenset[str]) -> str:
    """BSD licence of a text that has the conditions: the third clause forbids endorsement."""
    return "BSD-2-Clause" if "reproduce" in held and "endorse" not in held else "BSD-3-Clause"


def _three(words: list[str]) -> bool:
    return any(a == "3" and b == "clause" for a, b in zip(words, words[1:]))


def document_path(columns: tuple[str, ...] = ("source", "lang")) -> Column:
    """Directory of a document where the table has no path: source / language / block of 64 ids; every eighth document
    lies in its language's directory and every 64th in its source's, so ancestors hold files. A part whose column is not
    in ``columns`` is ``_``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_")) if c in columns else F.lit("_")
    i = F.col("doc_id")
    block = F.coalesce(F.floor(i / 64).cast("string"), F.lit("_"))
    return F.concat_ws("/", part("source"), F.when(i.isNull() | (F.pmod(i, F.lit(64)) != 0), part("lang")), F.when(i.isNull() | (F.pmod(i, F.lit(8)) != 0), block))


SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("directory", StringType()), StructField("own", StringType()), StructField("own_score", DoubleType()), StructField("as_file", StringType()), StructField("file_score", DoubleType())]
)


def licences(docs: DataFrame, directory: Column | None = None, header_min: float = HEADER_MIN, file_min: float = FILE_MIN) -> DataFrame:
    """One row per document: its licence, where it comes from, and the directory it was inherited from."""
    df, n = document_frequencies(docs)
    matcher = Matcher(df, n, min(header_min, file_min))

    def run(rows: list[tuple]) -> list[tuple]:
        return [(i, d, *matcher.scan(text, header_min, file_min)) for i, d, text in rows]

    table = docs.select("doc_id", (document_path(tuple(docs.columns)) if directory is None else directory).alias("directory"), "text")
    found = written(map_arrow(table, run, SCHEMA), "licences")
    return inherit(found)


def inherit(found: DataFrame) -> DataFrame:
    """Nearest-ancestor inheritance over (doc_id, directory, own, own_score, as_file, file_score)."""
    files = found.where("as_file is not null").groupBy("directory").agg(F.min(F.struct((-F.round("file_score", 9)).alias("s"), "doc_id", "as_file")).alias("f"))
    files = files.select(F.col("directory").alias("ancestor"), F.col("f.as_file").alias("inherited"))
    # Directories, not documents, are expanded to their ancestors, so a hot directory counts once.
    parts = F.split("directory", "/")
    level = F.explode(F.sequence(F.lit(1), F.size(parts)))
    dirs = found.select("directory").distinct().select("directory", level.alias("depth"))
    dirs = dirs.select("directory", "depth", F.array_join(F.slice(parts, 1, F.col("depth")), "/").alias("ancestor"))
    nearest = dirs.join(files, "ancestor").groupBy("directory").agg(F.max(F.struct("depth", "ancestor", "inherited")).alias("n"))
    out = found.join(nearest, "directory", "left")
    own = F.col("own").isNotNull()
    return out.select(
        "doc_id", "directory", F.coalesce("own", "n.inherited").alias("licence"),
        F.when(own, "header").when(F.col("n.inherited").isNotNull(), "inherited").alias("origin"), F.round("own_score", 6).alias("own_score"),
        F.when(~own, F.col("n.ancestor")).alias("inherited_from"), F.col("as_file").isNotNull().alias("is_licence_file"),
    )
