"""Licence scan by sentence rules.

A text is cut into sentences, which are normalised (lower case, runs of anything but ASCII letters and digits as one
space) and mapped to the identifiers of known licence sentences. A licence rule is an ordered sequence of such
identifiers; it matches where they follow one another in a document. Texts are read twice: with every line break as
the end of a sentence, and with lines joined (only blank lines end one), for licences wrapped at a margin.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
_APACHE_1 = "Licensed under the Apache License, Version 2.0 (the \"License\")"
_APACHE_2 = "you may not use this file except in compliance with the License"
_APACHE_3 = "You may obtain a copy of the License at"
_GPL_1 = "This program is free software"
_GPL_2 = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
_LGPL_2 = "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"
_GPL_V3 = "either version 3 of the License, or (at your option) any later version"
_GPL_V2 = "either version 2 of the License, or (at your option) any later version"
_LGPL_V21 = "either version 2.1 of the License, or (at your option) any later version"
_LGPL_1 = "This library is free software"
_MPL_1 = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"
_UNLICENSE_1 = "This is free and unencumbered software released into the public domain"
_AGPL_2 = "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"
_ZLIB = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"
_CC0 = "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"

#: The SPDX identifiers of each licence; those that end in "only" and "or later" are one licence.
_SPDX = {
    **{name: [name] for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "Zlib", "BSL-1.0")},
    **{name: [name, f"{name}-only", f"{name}-or-later"] for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")},
}
#: Licences of which two are often offered for choice.
_CHOSEN = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0")
#: What licences are called in notes such as "This file is released under the MIT License."
_CALLED = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
}
_WHAT = ("", "This file is ", "This software is ", "This project is ", "This code is ", "This work is ", "This library is ")
_DONE = ("released", "licensed", "distributed")
#: Sentences that mean the same and share an identifier.
ALIKE: list[list[str]] = [
    *[[f"{what}{done} under the {name}" for name in names for what in _WHAT for done in _DONE] for names in _CALLED.values()],
    *_SPDX.values(),
    *[[f"{one} {word} {other}" for a, b in ((x, y), (y, x)) for one in _SPDX[a] for other in _SPDX[b] for word in ("OR", "AND")] for k, x in enumerate(_CHOSEN) for y in _CHOSEN[:k]],
]

#: How the clauses of a numbered licence may begin; "1." is a sentence of its own, "1)" is not.
_NUMBERS = [("1. ", "2. ", "3. "), ("1) ", "2) ", "3) "), ("a. ", "b. ", "c. "), ("a) ", "b) ", "c) "), ("i. ", "ii. ", "iii. "), ("i) ", "ii) ", "iii) ")]


def _numbered(clauses: list[str]) -> list[list[str]]:
    return [[n + c for n, c in zip(numbers, clauses)] for numbers in _NUMBERS]


#: (licence, its sentences in order). Bullets that are marks, and quotes, don't matter; a sentence is given as it is written.
RULES: list[tuple[str, list[str]]] = [
    *[(name, [f"Licensed under the {called[0]}."]) for name, called in _CALLED.items()],
    *[(name, [f"SPDX-License-Identifier: {name}"]) for name in _SPDX],
    *[(name, [f"SPDX-License-Identifier: {x} OR {y}"]) for k, x in enumerate(_CHOSEN) for y in _CHOSEN[:k] for name in (x, y)],
    ("MIT", [_MIT_GRANT, _MIT_NOTICE, _MIT_AS_IS]),
    ("ISC", [_ISC_GRANT]),
    ("BSD-2-Clause", [_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY]),
    ("BSD-3-Clause", [_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_NAMES]),
    *[("BSD-2-Clause", [_BSD_GRANT, *clauses]) for clauses in _numbered([_BSD_SOURCE, _BSD_BINARY])],
    *[("BSD-3-Clause", [_BSD_GRANT, *clauses]) for clauses in _numbered([_BSD_SOURCE, _BSD_BINARY, _BSD_NAMES])],
    ("Apache-2.0", [_APACHE_1, _APACHE_2, _APACHE_3]),
    ("Apache-2.0", ["Apache License\nVersion 2.0, January 2004"]),
    ("GPL-3.0", ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"]),
    ("GPL-3.0", [_GPL_1, _GPL_2, _GPL_V3]),
    ("GPL-3.0", [_GPL_1, f"{_GPL_2}, {_GPL_V3}"]),
    ("AGPL-3.0", ["GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"]),
    ("AGPL-3.0", [_GPL_1, _AGPL_2, _GPL_V3]),
    ("AGPL-3.0", [_GPL_1, f"{_AGPL_2}, {_GPL_V3}"]),
    ("LGPL-3.0", ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"]),
    ("LGPL-2.1", ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"]),
    ("GPL-2.0", ["GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"]),
    ("GPL-2.0", [_GPL_1, _GPL_2, _GPL_V2]),
    ("GPL-2.0", [_GPL_1, f"{_GPL_2}, {_GPL_V2}"]),
    *[("LGPL-3.0", [first, *rest]) for first in (_GPL_1, _LGPL_1) for rest in ([_LGPL_2, _GPL_V3], [f"{_LGPL_2}, {_GPL_V3}"])],
    *[("LGPL-2.1", [first, *rest]) for first in (_GPL_1, _LGPL_1) for rest in ([_LGPL_2, _LGPL_V21], [f"{_LGPL_2}, {_LGPL_V21}"])],
    ("MPL-2.0", [_MPL_1]),
    ("MPL-2.0", ["Mozilla Public License Version 2.0"]),
    ("Zlib", [_ZLIB]),
    ("BSL-1.0", [_BOOST]),
    ("CC0-1.0", [_CC0]),
    ("CC-BY-4.0", ["Licensed under CC BY 4.0."]),
    ("CC-BY-4.0", ["This work is licensed under a Creative Commons Attribution 4.0 International License."]),
    ("CC-BY-SA-4.0", ["Licensed under CC BY-SA 4.0."]),
    ("CC-BY-SA-4.0", ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]),
    ("CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0."]),
    ("CC-BY-NC-4.0", ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."]),
    ("Unlicense", [_UNLICENSE_1]),
]
#: The end of a sentence: a stop and what clings to it before white space, or a line break.
_STOP = r"[.!?:;][^a-z0-9\s]*(\s+|$)|\n"
#: Every rule has a sentence with one of these; a text without any has no licence. Between words may be what a sentence
#: is normalised by, as a line break.
_HINT = r"licen[sc]|is[^a-z0-9]+hereby[^a-z0-9]+granted|redistribut|public[^a-z0-9]+domain"
#: The sentences are spread over so many maps by their checksum, as a map is searched from its first entry on.
_MAPS = 256


def _pieces(sentence: str) -> list[str]:
    """The normalised sentences that a written one is cut into."""
    return [y for x in re.split("\n", re.sub(_STOP, "\n", sentence.lower())) if (y := re.sub("[^a-z0-9]+", " ", x).strip())]


def compiled() -> tuple[dict[str, int], list[tuple[str, str]]]:
    """The known sentences' identifiers, and (licence, sequence) of each rule."""
    ids: dict[str, int] = {}
    for number, group in enumerate(ALIKE, 1):
        for sentence in group:
            (piece,) = _pieces(sentence)
            assert ids.setdefault(piece, number) == number, sentence
    rules = []
    for name, written in RULES:
        pieces = [p for s in written for p in _pieces(s)]
        assert any(re.search(_HINT, p) for p in pieces), name
        rules.append((name, "".join(f"|{ids.setdefault(p, len(ALIKE) + len(ids) + 1)}|" for p in pieces)))
    return ids, list(dict.fromkeys(rules))


def _known(ids: dict[str, int]) -> Column:
    """The identifiers as text, in an array of maps."""
    maps: list[dict[str, str]] = [{"": "0"} for _ in range(_MAPS)]
    for piece, number in ids.items():
        maps[zlib.crc32(piece.encode()) % _MAPS][piece] = str(number)
    return F.array(*[F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in m.items())) for m in maps])


def _sequence(text: Column, known: Column) -> Column:
    """The identifiers of the sentences in order, 0 for one that isn't known; empty sentences are left out."""
    cut = F.regexp_replace(text, _STOP, "\n")
    parts = F.split(F.regexp_replace(cut, r"[^a-z0-9\n]+", " "), "\n")
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.concat_ws("", F.transform(parts, lambda x: F.concat(F.lit("|"), F.coalesce(F.element_at(F.get(known, (F.crc32(x) % _MAPS).cast("int")), x), F.lit("0")), F.lit("|"))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, n_matches: how often the licence's rules match a row's text, of the two readings the larger.

    A rule within a longer one that also matches (BSD-2-Clause in BSD-3-Clause) counts as well. One row a licence and
    row of ``docs``: rows that repeat a doc_id each give theirs, a null doc_id is kept. Null, empty and unlicensed
    texts give none. Other columns, whatever their names, aren't read.
    """
    ids, rules = compiled()
    known = _known(ids)
    low = docs.select("doc_id", F.lower("text").alias("low")).filter(F.col("low").rlike(_HINT))
    wrapped = F.regexp_replace(F.regexp_replace("low", r"\n\s*\n", "!\n\n"), r"\n", " ")
    both = low.select("doc_id", _sequence(F.col("low"), known).alias("a"), _sequence(wrapped, known).alias("b"))

    def times(seq: str, name: str) -> Column:
        parts = [(F.length(seq) - F.length(F.replace(F.col(seq), F.lit(s)))) / len(s) for n, s in rules if n == name]
        return sum(parts[1:], parts[0]).cast("long")

    names = list(dict.fromkeys(n for n, _ in rules))
    hits = F.array(*[F.struct(F.lit(n).alias("license"), F.greatest(times("a", n), times("b", n)).alias("n_matches")) for n in names])
    return both.select("doc_id", F.explode(F.filter(hits, lambda h: h["n_matches"] > 0)).alias("h")).select("doc_id", "h.license", "h.n_matches")


def oracle() -> str:
    """The same over whole tables in DuckDB's dialect, by rows instead of strings' lengths."""
    ids, rules = compiled()
    values = ", ".join(f"('{k}', {v})" for k, v in ids.items())
    wanted = ", ".join(f"('{n}', {[int(x) for x in re.findall(r'[0-9]+', s)]})" for n, s in rules)
    read = "regexp_replace(regexp_replace(low, '\\n\\s*\\n', '!' || chr(10) || chr(10), 'g'), '\\n', ' ', 'g')"
    cut = "string_split(regexp_replace({}, '[.!?:;][^a-z0-9\\s]*(\\s+|$)|\\n', chr(10), 'g'), chr(10))"
    return f"""
WITH known(sentence, id) AS (VALUES {values}), rules(license, ids) AS (VALUES {wanted}),
texts AS (SELECT row_number() OVER () AS r, doc_id, lower(text) AS low FROM documents),
reads AS (SELECT r, doc_id, 1 AS way, {cut.format("low")} AS parts FROM texts UNION ALL SELECT r, doc_id, 2, {cut.format(read)} FROM texts),
cut AS (SELECT r, doc_id, way, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS parts FROM reads),
sentences AS (SELECT r, doc_id, way, i, c.parts[i] AS sentence FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut) c),
found AS (SELECT s.r, s.doc_id, s.way, s.i, k.id FROM sentences s JOIN known k ON s.sentence = k.sentence),
steps AS (SELECT license, ids, unnest(range(1, len(ids) + 1)) AS j FROM rules),
runs AS (SELECT f.r, f.doc_id, f.way, s.license, s.ids, f.i - s.j AS base, count(*) AS n FROM found f JOIN steps s ON f.id = s.ids[s.j] GROUP BY ALL),
counts AS (SELECT r, doc_id, way, license, count(*) AS n FROM runs WHERE n = len(ids) GROUP BY ALL)
SELECT doc_id, license, max(n)::BIGINT AS n_matches FROM counts GROUP BY r, doc_id, license
"""
