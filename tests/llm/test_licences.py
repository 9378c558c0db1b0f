"""Licences: rules over sequences of known sentences."""

import random
import re

import pytest

from doclake.llm import licences

MIT = licences.SENTENCES["mit-grant"][0]
TEXTS = {
    1: "Some words.\nLicensed under the Apache License, Version 2.0.",
    2: "Released under the MIT License.\n\n" + MIT.capitalize().replace(" free of charge", ", free of charge,") + ": x",
    3: "This work is licensed under the GNU General Public License, version 3. And more.",
    4: "LICENSED UNDER CC BY-NC 4.0!  Licensed under CC BY 4.0\nAll rights reserved.",
    5: "licensed under the apache license version 2 0 by me.\nmentions the MIT License in passing",
    6: None,
    7: "",
    8: "Released under the MIT License. " * 3 + "x " * 50000,
    9: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n 1. y\nNeither the name of the copyright holder nor the names of its contributors may "
    "be used to endorse or promote products derived from this software without specific prior written permission.",
}
WANT = {
    1: "Apache-2.0",
    2: "MIT",
    3: "GPL-3.0-only",
    4: "CC-BY-NC-4.0,CC-BY-4.0,proprietary",
    8: "MIT",
    9: "BSD-3-Clause",
    None: "MIT",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, v, 1, "x") for k, v in TEXTS.items()] + [(None, "MIT License", 1, "x"), (3, "nothing", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, place int, ident string").repartition(3)


def test_rules(docs):
    got = {r.doc_id: r.licences for r in licences.scan_licences(docs).collect()}
    assert got == WANT


def test_sequences(docs):
    got = {r.doc_id: r.sequence for r in licences.scan_licences(docs).collect()}
    assert got[2] == "<mit-line><mit-grant>" and got[8] == "<mit-line>" * 3


def test_dictionary_is_normalised():
    for sentence in (s for some in licences.SENTENCES.values() for s in some):
        assert sentence == " ".join(re.findall("[a-z0-9]+", sentence))
    assert {i for _, wanted in licences.RULES for i in wanted} <= set(licences.SENTENCES)


def test_empty(docs):
    assert licences.scan_licences(docs.where("false")).count() == 0


# Fixed texts: public wording of licences, as it stands in files.
WRAPPED = {
    "MIT": """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "GPL-3.0-or-later": """/*
 * Copyright (C) 2020 Somebody
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */""",
    "BSD-3-Clause": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 3. Neither the name of the copyright holder nor the names of its
#    contributors may be used to endorse or promote products derived from
#    this software without specific prior written permission.""",
    "MPL-2.0": """// This Source Code Form is subject to the terms of the Mozilla Public\r
// License, v. 2.0. If a copy of the MPL was not distributed""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0
# (the "License");
# you may not use this file except in compliance
# with the License.""",
}


def test_wrapped_texts(spark):
    rows = [(i, text) for i, text in enumerate(WRAPPED.values())]
    got = {r.doc_id: (r.licences, r.sequence) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: l for i, (l, _) in got.items()} == dict(enumerate(WRAPPED))
    assert got[0][1] == "<mit-grant><mit-notice>" and got[1][1] == "<gpl-redistribute><gpl-hope>"
    assert got[2][1] == "<bsd-grant><bsd-endorse>" and got[4][1] == "<apache-grant><apache-grant>"


def test_paragraphs_are_not_joined(spark):
    rows = [(1, "Licensed under the\n\nMIT License agreement"), (2, "licensed under\n *\n * the MIT license")]
    assert licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


MORE = {
    "GPL-2.0-or-later": """ * This program is free software; you can redistribute it and/or modify it under the terms of
 * the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms
of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the
License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """# This program is free software: you can redistribute it and/or modify it under the terms of the
# GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License,
# or (at your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT": "\n".join(licences.SENTENCES["mit-grant"][0].split()),  # one word a line
    "BSD-3-Clause": "// SPDX-License-Identifier: BSD-3-Clause",
    "GPL-2.0-only": "/* SPDX-License-Identifier: GPL-2.0-only */",
    "Apache-2.0": "Licensed under" + " " * 40_000 + "the Apache License, Version 2.0.",
}


def test_more_licences():
    for licence, text in MORE.items():
        found = "".join(f"<{i}>" for i in licences.identify(text))
        assert [name for name, wanted in licences.RULES if "".join(f"<{i}>" for i in wanted) in found][0] == licence


def test_rows_of_one_id_and_without_ids(spark):
    rows = [(None, "MIT License", 1), (None, "Licensed under CC BY 4.0", 1), (5, "All rights reserved.", 1), (5, "MIT License", 1), (5, "MIT License", 1)]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, idents int")).collect()
    want = [("None", "MIT"), ("None", "CC-BY-4.0"), ("5", "proprietary"), ("5", "MIT"), ("5", "MIT")]
    assert sorted((str(r.doc_id), r.licences) for r in got) == sorted(want)


def brute(text):
    """All runs of pieces of each paragraph, joined and compared with every known sentence."""
    known = {s: ident for ident, some in licences.SENTENCES.items() for s in some}
    paragraphs, at = [[]], 0
    for end in [*re.finditer(licences.ENDS, text), None]:
        piece = text[at : end.start() if end else len(text)]
        words = " ".join(re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in piece)))
        if words:
            paragraphs[-1].append(words)
        if end is not None and (end.group().count("\n") > 1 or (piece and not words)):
            paragraphs.append([])
        at = end.end() if end else at
    found = []
    for pieces in paragraphs:
        runs = {}
        for i in range(len(pieces)):
            for n in range(1, len(pieces) - i + 1):
                said = " ".join(pieces[i : i + n])
                if said in known:
                    runs[i] = (n, known[said])
        for i, (n, ident) in sorted(runs.items()):
            if not any(j < i < j + m for j, (m, _) in runs.items() if m > 1):
                found.append(ident)
    return found


def test_wrapped_texts_against_brute_force():
    rng = random.Random(2)
    sentences = [s for some in licences.SENTENCES.values() for s in some]
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += rng.choice([rng.choice(sentences).split(), ["other", "words"], ["É", "the", "license"], []])
        text = ""
        for word in words:
            text += rng.choice([word, word.upper(), word.capitalize()])
            text += rng.choice([" ", " ", " ", ", ", "\n", "\n# ", ": ", ". ", "\n\n", "\n *\n * "] if rng.random() < 0.3 else [" "])
        assert licences.identify(text) == brute(text), text
