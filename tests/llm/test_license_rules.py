import re

from spendaudit.llm.license_rules import RULES, SENTENCES, known_sentences, license_scan, rules_met
from tests.llm.conftest import prose


def brute(text):
    known = {s: letter for letter, s in SENTENCES.items()}
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    letters = ""
    for sentence in re.split(r"\n|[.!?:;]+(?:[\x20\x09-\x0D]|\Z)", text):
        letters += known.get(" ".join(re.findall("[a-z0-9]+", sentence)), "")
    met, at = [], 0
    while at < len(letters):
        rule = next((r for r in RULES if letters.startswith(r[0], at)), None)
        met += [rule] if rule else []
        at += len(rule[0]) if rule else 1
    return len(letters), letters, ",".join(sorted({r[1] for r in met})), ",".join(sorted({r[2] for r in met}))


def sentence(letter):
    return SENTENCES[letter].capitalize() + "."


TEXTS = [
    None, "", "Released under the MIT License.", "x\nreleased   under the (MIT) license\ny", "Licensed under CC BY-NC 4.0. " + prose(1, 30),
    " ".join(map(sentence, "ABCDE")), " ".join(map(sentence, "GHI")), " ".join(map(sentence, "PQRP")), " ".join(map(sentence, "LKKL")),
    sentence("A") + " " + prose(2, 20) + ". " + sentence("B"), "He has a license to drive. The license was released under the mit license plan.",
    "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!", prose(3, 30000) + "\n" + sentence("J"), sentence("J"), sentence("J"), "Kicensed license",
]


def test_scan_matches_brute_force(make_docs):
    rows = {r.doc_id: r for r in license_scan(make_docs(*TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert (rows[i].n_sentences, rows[i].sentences, rows[i].licences, rows[i].kinds) == brute(text), text
        for s in rows[i].spans:
            assert known_sentences(text[s.start : s.end])[0][2] == s.sentence
    assert rows[5].licences == "Apache-2.0" and rows[6].licences == "MIT" and rows[7].licences == "BSD-2-Clause,BSD-3-Clause"


def test_earlier_rules_win_and_take_their_sentences():
    assert rules_met("GHI") == ["GHI"] and rules_met("GHAB") == ["GH", "AB"] and rules_met("HI") == [] and rules_met("PQPQR") == ["PQ", "PQR"]


APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Copyright (c) 2020, Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {} as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
ORIGINALS = [
    (APACHE, "VBCDE", "Apache-2.0"), (MIT, "GHI", "MIT"), (BSD, "UPQn", "BSD-2-Clause"), (BSD3, "UPQnR", "BSD-3-Clause"),
    (GPL.format("General Public License", ",", 3), "W", "GPL-3.0-or-later"), (GPL.format("General Public License", ";", 2), "Ya", "GPL-2.0-or-later"),
    (GPL.format("Lesser General Public License", ",", 3), "c", "LGPL-3.0-or-later"), (GPL.format("Lesser General Public License", ";", 2.1), "ef", "LGPL-2.1-or-later"),
    (GPL.format("Affero General Public License", ",", 3), "g", "AGPL-3.0-or-later"), (MPL, "h", "MPL-2.0"), (ISC, "i", "ISC"),
    ("Intro.\nAll rights reserved.\nMore.", "U", "All-Rights-Reserved"),
]


def test_original_wrapped_licence_texts(make_docs):
    marks = ["", "# ", " * ", "// "]
    texts = [prose(1, 20) + "\n\n" + "\n".join(mark + line for line in text.split("\n")) + "\n" for text, _, _ in ORIGINALS for mark in marks]
    rows = {r.doc_id: r for r in license_scan(make_docs(*texts)).collect()}
    for i, text in enumerate(texts):
        _, letters, licence = ORIGINALS[i // len(marks)]
        assert (rows[i].sentences, rows[i].licences) == (letters, licence), text
        for s in rows[i].spans:
            assert known_sentences(text[s.start : s.end])[0][2] == s.sentence


def test_sentences_do_not_cross_blank_lines_or_end_marks():
    assert known_sentences("released under\nthe mit license") == [(0, 30, "F")]
    assert known_sentences("released under\n\nthe mit license") == [] and known_sentences("released under.\nthe mit license") == []
    assert known_sentences("released under\n#\n# the mit license") == []


def test_empty_table(make_docs):
    assert license_scan(make_docs()).collect() == []
