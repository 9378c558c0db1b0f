"""Licences named in documents: known sentences, then rules over the sequence of their identifiers.

Texts are cut at sentence ends and line breaks. Licence texts are wrapped, stand in comments and have colons and
abbreviations inside their sentences, so the normalised words of a paragraph are run through a trie of the known
sentences from the beginning of each piece; of overlapping runs the longest counts. The identifiers of a
document's known sentences, in order, form its sequence. Rules are tried in order, most specific first: a rule that matches takes its identifiers out of
the sequence, so that a later, more general rule does not see them again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

# Sentences after normalisation, and the licences that their sequences mean.
SENTENCES = {
    "apache-line": ["licensed under the apache license version 2 0"],
    "apache-grant": [
        "licensed under the apache license version 2 0 the license",
        "you may not use this file except in compliance with the license",
    ],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-as-is": [
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "mit-line": ["released under the mit license", "licensed under the mit license", "mit license"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit-notice": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software"
    ],
    "gpl3-line": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
    ],
    "gpl2-line": [
        "this work is licensed under the gnu general public license version 2",
        "licensed under the gnu general public license version 2",
    ],
    "gpl-redistribute": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version"
    ],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "bsd-grant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met"
    ],
    "bsd-endorse": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission"
    ],
    "gpl2-redistribute": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 2 of the license or at your "
        "option any later version"
    ],
    "lgpl21-redistribute": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation either version 2 1 of the license or at "
        "your option any later version"
    ],
    "agpl3-redistribute": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
        "general public license as published by the free software foundation either version 3 of the license or at "
        "your option any later version"
    ],
    "bsd-disclaimer": [
        "this software is provided by the copyright holders and contributors as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness for a "
        "particular purpose are disclaimed"
    ],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "unlicense-line": ["this is free and unencumbered software released into the public domain"],
    "cc-by-nc-line": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "cc-by-sa-line": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"],
    "cc-by-line": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0"],
    "mpl-line": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "reserved": ["all rights reserved"],
}
#: Identifiers that stand in a line of their own after "SPDX-License-Identifier:".
SPDX = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 "
    "EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later "
    "LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 Unlicense Zlib"
).split()
RULES = [
    ("Apache-2.0", ["apache-grant", "apache-grant", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", ["apache-grant", "apache-grant"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-line"]),
    ("MIT", ["mit-line", "mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-line"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-redistribute"]),
    ("GPL-3.0-only", ["gpl3-line"]),
    ("GPL-2.0-only", ["gpl2-line"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-endorse", "bsd-disclaimer"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-disclaimer"]),
    ("BSD-2-Clause", ["bsd-grant"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-line"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-line"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-line"]),
    ("CC-BY-4.0", ["cc-by-line"]),
    ("MPL-2.0", ["mpl-line"]),
    ("proprietary", ["reserved"]),
]

SENTENCES |= {f"spdx:{name}": ["spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower())] for name in SPDX}
RULES += [(name, [f"spdx:{name}"]) for name in SPDX]

#: Ends of sentences and lines, and what normalisation turns into one space.
ENDS = r"[.!?;:][ \t\r\f]+|[ \t\r\f]*\n[ \t\r\f\n]*"
OTHER = r"[^a-z0-9]+"
_KNOWN = [s for some in SENTENCES.values() for s in some]
#: A text without any of these words holds no known sentence: the longest word of each.
HINTS = sorted({max(s.split(), key=len).encode() for s in _KNOWN})

_ends = re.compile(ENDS.encode())
_words = re.compile(rb"[a-z0-9]+")


def _trie() -> dict:
    """Known sentences word by word; the identifier stands under the key None."""
    root: dict = {}
    for ident, some in SENTENCES.items():
        for sentence in some:
            node = root
            for word in sentence.encode().split():
                node = node.setdefault(word, {})
            node[None] = ident
    return root


_TRIE = _trie()


def paragraphs(text: bytes) -> Iterator[list[list[bytes]]]:
    """The words of each piece of each paragraph. Blank lines and lines of comment marks alone part paragraphs."""
    pieces, at = [], 0
    for end in [*_ends.finditer(text), None]:
        piece = text[at : end.start() if end else len(text)]
        words = _words.findall(piece)
        if words:
            pieces.append(words)
        if end is None or end.group().count(b"\n") > 1 or (piece and not words):
            if pieces:
                yield pieces
            pieces = []
        at = end.end() if end else at


def identify(text: str | None) -> list[str]:
    """Identifiers of the known sentences of a text, in order.

    A known sentence begins and ends with a piece and may run over any number of them; from each piece the
    longest counts, and one that begins inside a longer run before it does not.
    """
    text = (text or "").encode("utf-8", "replace").lower()
    if not any(hint in text for hint in HINTS):
        return []
    found = []
    for pieces in paragraphs(text):
        covered = 0
        for first in range(len(pieces)):
            node, last, ident = _TRIE, 0, None
            for k in range(first, len(pieces)):
                for word in pieces[k]:
                    node = node.get(word)
                    if node is None:
                        break
                if node is None:
                    break
                if None in node:
                    last, ident = k + 1, node[None]
            if ident is not None:
                if first >= covered:
                    found.append(ident)
                if last > first + 1:
                    covered = max(covered, last)
    return found


def known_sentences(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``idents``, in order, of every row with a known sentence; one narrow pass."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(i, found) for i, text in zip(batch.column(0).to_pylist(), batch.column(1)) if (found := identify(text.as_py()))]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "idents"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, idents array<string>")


def _apply(rules: list[tuple[str, list[str]]], sequence: Column) -> Column:
    """Licences found, in the order of the rules, by taking each rule's identifiers out of ``sequence``."""
    found = []
    for licence, wanted in rules:
        pattern = "".join(f"<{ident}>" for ident in wanted)
        found.append(F.when(F.contains(sequence, F.lit(pattern)), F.lit(licence)))
        sequence = F.replace(sequence, F.lit(pattern), F.lit("#"))
    return F.array_distinct(F.array_compact(F.array(*found)))


def scan_licences(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``sequence`` (identifiers in order) and ``licences`` of the rows that hold any known sentence.

    Null and empty texts hold none. Every row is read by itself, also if others have its id or it has none, and
    repeated rows give a row each. Other columns are ignored; an empty table gives no rows. Nothing is shuffled.
    """
    sequence = F.array_join(F.transform("idents", lambda ident: F.concat(F.lit("<"), ident, F.lit(">"))), "")
    found = known_sentences(docs).select("doc_id", sequence.alias("sequence"))
    return found.select("doc_id", "sequence", F.array_join(_apply(RULES, F.col("sequence")), ",").alias("licences"))


def oracle() -> str:
    """The same over ``documents`` for the checking engine."""
    rows = ", ".join(f"('{s}', '{i}')" for i, some in SENTENCES.items() for s in some)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sequence, found = "sequence", []
    for licence, wanted in RULES:
        pattern = "".join(f"<{ident}>" for ident in wanted)
        found.append(f"CASE WHEN contains({sequence}, '{pattern}') THEN '{licence}' END")
        sequence = f"replace({sequence}, '{pattern}', '#')"
    kept = f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"
    return f"""
    WITH known(sentence, ident) AS (VALUES {rows}),
    raw AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS place
            FROM (SELECT doc_id, regexp_split_to_array(text, '{ENDS}') AS s FROM documents)),
    said AS (SELECT doc_id, place, trim(regexp_replace(translate(s[place], '{upper}', '{lower}'), '{OTHER}', ' ', 'g'))
                    AS sentence FROM raw),
    grouped AS (SELECT doc_id, string_agg('<' || ident || '>', '' ORDER BY place, ident) AS sequence
                FROM said JOIN known USING (sentence) GROUP BY doc_id)
    SELECT doc_id, sequence,
           array_to_string(list_filter({kept}, lambda x, i: list_position({kept}, x) = i), ',') AS licences
    FROM grouped"""
