"""License scan with ordered signature rules.

A text is reduced to its words (runs of letters, digits and anything beyond ASCII, A-Z in lower
case) joined by single spaces. Hundreds of signatures are regular expressions over words: texts,
names, versions, SPDX tags and short phrases of license families, each with a label, a priority and
a strength. Most texts hold none of the keywords that every signature needs, and are done after a
substring search; else only signatures whose keyword occurs are tried. Overlapping detections are
resolved in priority order: a detection inside the interval of one that ranks higher, or equally
high and longer, is suppressed, and so is a family's plain mention inside a versioned one. The base
phrases are found apart, all of them, whatever the rules suppress.

Defined cases: a null or empty text has no words, labels or places; rows that repeat are scanned
each for itself; texts are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tablesync.llm.common import byte_texts

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

SEPARATORS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
NUMBER = r"(?:version |v )?(\d+(?: \d+)?)"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    strength: float
    keyword: bytes
    pattern: re.Pattern


@dataclass(frozen=True)
class Family:
    """A license family: how it is written, its SPDX prefix, and the versions it has."""

    label: str
    names: tuple[str, ...]
    spdx: str
    versions: tuple[str, ...] = ()
    notice: tuple[str, ...] = ()


# License families as they are written in notices, and phrases of their texts.
FAMILIES = (
    Family("gpl", ("gnu general public licen[cs]e", "gnu gpl", "gpl"), "gpl", ("1 0", "2 0", "3 0"),
           ("this program is free software you can redistribute it and or modify it under the terms",)),
    Family("lgpl", ("gnu (?:lesser|library) general public licen[cs]e", "gnu lgpl", "lgpl"), "lgpl", ("2 0", "2 1", "3 0"),
           ("this library is free software you can redistribute it and or modify it under the terms",)),
    Family("agpl", ("gnu affero general public licen[cs]e", "affero gpl", "agpl"), "agpl", ("1 0", "3 0"),
           ("remote network interaction use with the gnu general public license",)),
    Family("gfdl", ("gnu free documentation licen[cs]e", "gfdl"), "gfdl", ("1 1", "1 2", "1 3"), ("with no invariant sections no front cover texts",)),
    Family("apache", ("apache licen[cs]e", "apache software licen[cs]e", "asl"), "apache", ("1 0", "1 1", "2 0"),
           ("unless required by applicable law or agreed to in writing software distributed under the license",)),
    Family("mit", ("mit licen[cs]e", "expat licen[cs]e", "x11 licen[cs]e"), "mit", (),
           ("permission is hereby granted free of charge to any person obtaining a copy of this software",)),
    Family("bsd", ("bsd licen[cs]e", "(?:simplified|modified|new|revised|original) bsd licen[cs]e", r"bsd [234] clause(?: licen[cs]e)?"), "bsd",
           ("2 clause", "3 clause", "4 clause"), ("redistribution and use in source and binary forms with or without modification are permitted",)),
    Family("mpl", ("mozilla public licen[cs]e", "mpl"), "mpl", ("1 0", "1 1", "2 0"), ("this source code form is subject to the terms of the mozilla public license",)),
    Family("epl", ("eclipse public licen[cs]e", "epl"), "epl", ("1 0", "2 0"), ("this program and the accompanying materials are made available under the terms of the eclipse",)),
    Family("cddl", ("common development and distribution licen[cs]e", "cddl"), "cddl", ("1 0", "1 1")),
    Family("cpl", ("common public licen[cs]e",), "cpl", ("1 0",)),
    Family("eupl", ("european union public licen[cs]e", "eupl"), "eupl", ("1 0", "1 1", "1 2")),
    Family("artistic", ("artistic licen[cs]e",), "artistic", ("1 0", "2 0")),
    Family("boost", ("boost software licen[cs]e",), "bsl", ("1 0",)),
    Family("isc", ("isc licen[cs]e",), "isc", (), ("permission to use copy modify and or distribute this software for any purpose",)),
    Family("zlib", ("zlib licen[cs]e", "zlib libpng licen[cs]e"), "zlib", (), ("this software is provided as is without any express or implied warranty",)),
    Family("unlicense", ("the unlicen[cs]e",), "unlicense", (), ("this is free and unencumbered software released into the public domain",)),
    Family("wtfpl", ("do what the fuck you want to public licen[cs]e", "wtfpl"), "wtfpl", ("2 0",)),
    Family("psf", ("python software foundation licen[cs]e", "psf licen[cs]e"), "psf", ("2 0",)),
    Family("ofl", ("sil open font licen[cs]e", "open font licen[cs]e"), "ofl", ("1 0", "1 1")),
    Family("odbl", ("open (?:data commons open )?database licen[cs]e", "odbl"), "odbl", ("1 0",)),
    Family("odc-by", ("open data commons attribution licen[cs]e",), "odc by", ("1 0",)),
    Family("ms-pl", ("microsoft public licen[cs]e",), "ms pl"),
    Family("ms-rl", ("microsoft reciprocal licen[cs]e",), "ms rl"),
    Family("osl", ("open software licen[cs]e",), "osl", ("1 0", "2 1", "3 0")),
    Family("afl", ("academic free licen[cs]e",), "afl", ("1 2", "2 1", "3 0")),
    Family("upl", ("universal permissive licen[cs]e",), "upl", ("1 0",)),
    Family("postgresql", ("postgresql licen[cs]e",), "postgresql"),
    Family("openssl", ("openssl licen[cs]e",), "openssl"),
    Family("ecl", ("educational community licen[cs]e",), "ecl", ("1 0", "2 0")),
    Family("cecill", ("cecill(?: [abc])? licen[cs]e", "cecill"), "cecill", ("1 0", "2 0", "2 1")),
    Family("bsl", ("business source licen[cs]e",), "busl", ("1 1",)),
    Family("sspl", ("server side public licen[cs]e", "sspl"), "sspl", ("1 0",)),
    Family("elastic", ("elastic licen[cs]e",), "elastic", ("1 0", "2 0")),
    Family("cc0", ("cc0", "creative commons zero", "cc zero"), "cc0", ("1 0",)),
)
# The parts of Creative Commons names.
CC = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s"), ("by-nc", "attribution non ?commercial"),
      ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s"))
# Sentences of license texts and notices that tell which license it is.
SENTENCES = (
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "you should have received a copy of the gnu general public license along with this"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "neither the names? of (?:[^ ]+ ){1,20}may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("cc0", "to the extent possible under law (?:[^ ]+ ){1,20}waived all copyright and related or neighboring rights"),
    ("ofl", "this font software is licensed under the sil open font license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
)
# Statements that are no license of their own.
STATEMENTS = (
    ("public-domain", 20, 0.6, "public domain", r"(?:released into|dedicated to|in|placed in) the public domain"),
    ("all-rights-reserved", 10, 0.5, "all rights reserved", r"all rights reserved"),
    ("copyright", 5, 0.2, "copyright", r"copyright(?: c)?(?: \d{4}(?: \d{4})*)?(?: by)?"),
    ("proprietary", 25, 0.7, "proprietary", r"(?:proprietary and confidential|proprietary licen[cs]e|proprietary software)"),
    ("no-redistribution", 25, 0.7, "redistribut", r"redistribution (?:is )?(?:prohibited|not permitted|not allowed)"),
    ("no-commercial-use", 25, 0.6, "commercial", r"(?:non commercial use only|not for commercial use|no commercial use)"),
    ("permission-granted", 15, 0.4, "permission", r"permission is (?:hereby )?granted"),
    ("as-is", 5, 0.2, "as is", r"provided as is(?: without warranty)?"),
)


TAG = "spdx licen[cs]e identifier"


def versioned(family: str, version: str) -> tuple[str, str]:
    """The label of a family's version, and the pattern of its number."""
    major, _, minor = version.partition(" ")
    if minor == "0":
        return f"{family}-{major}", f"{major}(?: 0)?"
    return f"{family}-{version.replace(' ', '.' if minor.isdigit() else '-')}", version


def rules() -> list[Rule]:
    """All signatures, highest priority first."""
    out: list[Rule] = []

    def add(label, priority, strength, keyword, pattern):
        out.append(Rule(label, priority, strength, keyword.encode(), re.compile(rb" (?:" + pattern.encode() + rb")(?= )")))

    licensed = r"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?"
    for f in FAMILIES:
        for text in f.notice:
            add(f.label, 90, 1.0, text.split(" ", 1)[0] + " " + text.split(" ", 2)[1], text)
        for name in f.names:
            keyword = re.split(r"[\[(\\?]", name)[0].strip() or f.spdx
            for version in f.versions:
                label, number = versioned(f.label, version)
                tail = rf"(?: ?version| ?v)? ?{number}"
                add(label, 70, 0.9, keyword, rf"{name}{tail}")
                add(label, 80, 0.95, keyword, rf"{licensed}{name}{tail}")
                add(f"{label}-or-later", 85, 0.95, keyword, rf"{name}{tail} or (?:at your option )?(?:any )?later(?: version)?")
            add(f.label, 60, 0.85, keyword, licensed + name)
            add(f.label, 50, 0.7, keyword, name)
        add(f.label, 95, 1.0, "spdx", rf"{TAG} {f.spdx}(?: {NUMBER})?(?: only| or later)?")
        for version in f.versions:
            label, number = versioned(f.label, version)
            add(label, 97, 1.0, "spdx", rf"{TAG} {f.spdx} {number}(?: only)?")
            add(f"{label}-or-later", 98, 1.0, "spdx", rf"{TAG} {f.spdx} {number} or later")
    for code, words in CC:
        short = "cc " + code.replace("-", " ")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{code}-{version.replace(' ', '.')}"
            add(label, 75 + len(code), 0.9, "cc by", rf"{short} {version}")
            add(label, 75 + len(code), 0.95, "creative commons", rf"creative commons {words}(?: (?:international|unported))?(?: public)?(?: licen[cs]e)? {version}")
            add(label, 97, 1.0, "creativecommons", rf"creativecommons org licenses {code.replace('-', ' ')} {version}")
            add(label, 97, 1.0, "spdx", rf"{TAG} {short} {version}")
        add(f"cc-{code}", 55 + len(code), 0.75, "cc by", short)
        add(f"cc-{code}", 55 + len(code), 0.8, "creative commons", rf"creative commons {words}")
        add(f"cc-{code}", 95, 1.0, "creativecommons", rf"creativecommons org licenses {code.replace('-', ' ')}")
    for label, sentence in SENTENCES:
        add(label, 92, 1.0, " ".join(re.split(r"[(?]", sentence)[0].split(" ")[:-1][:4]), sentence)
    for label, priority, strength, keyword, pattern in STATEMENTS:
        add(label, priority, strength, keyword, pattern)
    return sorted(out, key=lambda r: -r.priority)


RULES = rules()
KEYWORDS: dict[bytes, list[Rule]] = {}
for _rule in RULES:
    KEYWORDS.setdefault(_rule.keyword, []).append(_rule)
BASE = re.compile(b" (?:" + b"|".join(p.encode() for p in PHRASES) + b")(?= )")


def detections(text: bytes) -> list[tuple[int, int, Rule]]:
    """Surviving detections (start, end, rule) of a text of words, by place."""
    found = [(m.start(), m.end(), r) for k, rs in KEYWORDS.items() if k in text for r in rs for m in r.pattern.finditer(text)]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    starts = sorted({d[0] for d in found})
    reach = [0] * (len(starts) + 1)  # a tree of the furthest ends by start
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in found:
        place = bisect_right(starts, start)
        i, furthest = place, 0
        while i:
            furthest = max(furthest, reach[i])
            i -= i & -i
        if furthest >= end:
            continue
        kept.append((start, end, rule))
        while place < len(reach):
            reach[place] = max(reach[place], end)
            place += place & -place
    return sorted(kept, key=lambda d: d[:2])


def scan_text(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of one text."""
    words = text.lower().translate(SEPARATORS).split()
    joined = b" " + b" ".join(words) + b" "
    places = [(m.start(), PHRASES[m.group()[1:].decode()]) for m in BASE.finditer(joined)] if b"licen" in joined or b" cc " in joined else []
    base = {label for _, label in places}
    kept = detections(joined)
    doubt = 1.0
    for rule in {r.label: r for _, _, r in sorted(kept, key=lambda d: d[2].strength)}.values():
        doubt *= 1 - rule.strength
    if base:
        doubt = min(doubt, 0.3)
    word_at = lambda i: joined.count(b" ", 0, i)
    return (
        len(words), len(places), word_at(places[0][0]) if places else None, word_at(places[-1][0]) if places else None,
        ",".join(sorted(base)), ",".join(sorted(base | {r.label for _, _, r in kept})), 1 - doubt,
    )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document, in the columns of SCHEMA."""

    def run(batches):
        for b in batches:
            rows = [scan_text(t) for t in byte_texts(b.column("text"))]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
